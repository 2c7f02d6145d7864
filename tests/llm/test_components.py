"""Connected components against union-find: empty, loops, a chain, hubs, random edges."""

import random
from orderlens.llm.components import components
def expected(e):
    p={}
    def f(x):
        while p.setdefault(x,x)!=x: x=p[x]
        return x
    for a,b in e:
        if a!=b:
            x,y=f(a),f(b); p[max(x,y)]=min(x,y)
    return {x:f(x) for x in p}
def test_cc(spark):
    r=random.Random(4)
    for e in ([], [(5,5)], [(k,k+1) for k in range(60)], [(0,k) for k in range(1,300)], [(k,999) for k in range(300)], [(r.randint(0,150),r.randint(0,150)) for _ in range(120)], [(9,1),(9,2),(3,2),(3,1)]):
        got=[(x.node,x.component) for x in components(spark.createDataFrame(e,"u long, v long")).collect()]
        assert len(got)==len(set(got)) and dict(got)==expected(e)
