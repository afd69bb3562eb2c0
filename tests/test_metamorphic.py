"""Counts that must agree with each other, whatever the records: parts add up, and rewritten conditions count the same."""

import datetime as dt
import random

import pytest

from tallyhouse.engine import Engine

N = 260


@pytest.fixture(scope="module")
def engine(spark):
    r = random.Random(2024)
    maybe = lambda v, share: None if r.random() < share else v
    rows = [
        (i, maybe(int(r.expovariate(1 / 300)), 0.1), maybe(r.randint(-60, 60), 0.2), maybe(r.choice(["oak", "elm", "ash", "fir", "yew"]), 0.15), maybe(r.random() < 0.4, 0.1),
         maybe(dt.date(2021, 11, 1) + dt.timedelta(r.randrange(400)), 0.1), [x for x in ("tall", "old", "sick") if r.random() < 0.4] or None)
        for i in range(1, N + 1)
    ]
    e = Engine(spark)
    e.attach("trees", spark.createDataFrame(rows, "id long, height long, lean long, kind string, felled boolean, planted date, marks array<string>"), "id")
    return e


def leaf(r: random.Random) -> str:
    number, op = r.randint(-40, 700), r.choice(["<", "<=", ">", ">=", "=", "!="])
    return r.choice([
        f"height {op} {number}", f"lean {op} {number % 50}", f"kind = '{r.choice(['oak', 'elm', 'none'])}'", "kind IN ('ash', 'fir')", "kind NOT IN ('yew')", "kind LIKE '%l%'", "felled", "felled = false",
        f"height BETWEEN {number} AND {number + 150}", f"planted {op} '2022-0{1 + number % 9}-10'", f"round(height, -1) >= {number // 10 * 10}", "toYear(planted) = 2021", f"marks = '{r.choice(['tall', 'sick'])}'", "_record_id IN (SELECT _record_id FROM trees WHERE lean > 10)",
    ])


def tree(r: random.Random, depth: int) -> str:
    kind = r.choice(["leaf", "AND", "OR", "NOT"]) if depth else "leaf"
    if kind == "leaf":
        return leaf(r)
    return f"NOT ({tree(r, depth - 1)})" if kind == "NOT" else f"({tree(r, depth - 1)} {kind} {tree(r, depth - 1)})"


@pytest.mark.parametrize("seed", range(12))
def test_laws(engine, seed):
    r = random.Random(seed)
    p, q, x = (tree(r, 2) for _ in range(3))
    laws = [
        (p, f"NOT (NOT ({p}))"),
        (f"NOT (({p}) OR ({q}))", f"NOT ({p}) AND NOT ({q})"),
        (f"({p}) AND (({q}) OR ({x}))", f"(({p}) AND ({q})) OR (({p}) AND ({x}))"),
        (f"({p}) OR (({p}) AND ({q}))", p),
    ]
    sums = [f"countIf({c}) AS c{k}" for k, c in enumerate([c for pair in laws for c in pair])]
    found = engine.sql(f"SELECT {', '.join(sums)} FROM trees").first()
    for k, pair in enumerate(laws):
        assert found[2 * k] == found[2 * k + 1], pair
    # as a filter, before aggregation, a condition keeps the records that the measure counts; its complement the others
    assert engine.sql(f"SELECT count(*) FROM trees WHERE {p}").first()[0] == found[0]
    assert engine.sql(f"SELECT count(*) FROM trees WHERE NOT ({p})").first()[0] == N - found[0]


def test_groups_and_rollups_add_up(engine):
    one = lambda text: engine.sql(text).first()[0]
    by = {k: (n, t) for k, n, t in engine.sql("SELECT kind, count(*) AS n, sum(height) AS t FROM trees GROUP BY kind").collect()}
    assert sum(n for n, _ in by.values()) == one("SELECT count(*) FROM trees WHERE kind LIKE '%'")
    assert sum(t for _, t in by.values()) == one("SELECT sum(height) FROM trees WHERE kind LIKE '%'")
    assert one("SELECT sum(lean) FROM trees") == one("SELECT sum(lean) FROM trees WHERE felled") + one("SELECT sum(lean) FROM trees WHERE NOT felled")
    rolled = {(k, y): n for k, y, n in engine.sql("SELECT kind, date_trunc('year', planted) AS y, count(*) AS n FROM trees GROUP BY kind, date_trunc('year', planted) WITH ROLLUP").collect()}
    assert rolled[None, None] == N
    for k, (n, _) in by.items():
        assert rolled[k, None] == n >= sum(v for (kind, y), v in rolled.items() if kind == k and y is not None)
    marked = dict(engine.sql("SELECT marks, count(*) AS n FROM trees GROUP BY marks").collect())
    assert marked == {m: one(f"SELECT count(*) FROM trees WHERE marks = '{m}'") for m in ("old", "sick", "tall")}


def test_samples_and_joins(engine):
    one = lambda text: engine.sql(text).first()[0]
    assert [one(f"SELECT count(*) FROM trees SAMPLE 1/{n}") for n in (2, 5)] == [N // 2, N // 5]
    assert one("SELECT count(*) FROM trees SAMPLE 1/4 WHERE height > 90") <= one("SELECT count(*) FROM trees SAMPLE 1/2 WHERE height > 90") <= one("SELECT count(*) FROM trees WHERE height > 90")
    pairs = sum(n * n for _, n in engine.sql("SELECT kind, count(*) AS n FROM trees GROUP BY kind").collect())
    assert one("SELECT count(*) FROM trees a JOIN trees b ON a.kind = b.kind") == pairs
    assert one("SELECT count(*) FROM trees a FULL JOIN trees b ON a.kind = b.kind") == pairs


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(500).selectExpr("id", "id * 3 % 17 as ring", "cast(id % 5 as string) as bark", "id as unused").write.parquet(str(tmp_path / "logs"))
    e = Engine(spark)
    e.attach("logs", spark.read.parquet(str(tmp_path / "logs")), "id")
    plan = e.sql("SELECT count(*) FROM logs WHERE ring < 9 AND NOT bark = '2'")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(ring,9)" in plan and "ReadSchema: struct<ring:bigint,bark:string>" in plan


def test_rollups_read_once(spark, tmp_path):
    spark.range(50).selectExpr("id", "id % 3 as a", "cast(id % 5 as string) as b").write.parquet(str(tmp_path / "r"))
    e = Engine(spark)
    e.attach("r", spark.read.parquet(str(tmp_path / "r")), "id")
    out = e.sql("SELECT a, b, count(*) AS n FROM r GROUP BY a, b WITH CUBE")
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1 and out.count() == 15 + 3 + 5 + 1
