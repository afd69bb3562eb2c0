"""The engine over small tables with gaps, against DuckDB and by hand."""

import datetime as dt
from decimal import Decimal as D

import duckdb
import pytest

from tallyhouse.engine import Engine
from tallyhouse.refusal import Refused


def rows(df):
    return [tuple(r) for r in df.collect()]


# metres, fare, drift, line, depot, paid, day, at
RIDES = [
    (3, 1250, D("3.40"), -7, "red", "north", True, "2023-03-31", "2023-03-31 06:15:00"),
    (4, 80, D("1.05"), 12, "blue", "north", False, "2023-04-01", "2023-04-01 00:00:00"),
    (7, 1250, D("3.40"), 0, "red", "south", True, "2023-04-02", "2023-04-02 23:59:59"),
    (8, None, D("9.99"), 3, "green", "south", True, "2024-02-29", "2024-02-29 12:30:45"),
    (11, 640, None, -7, "blue", "east", None, "2024-03-01", "2024-03-01 12:00:00"),
    (12, 2975, D("20.00"), None, None, "east", False, None, "1968-05-17 04:05:06"),
    (15, 640, D("2.50"), 40, "red", None, True, "2023-12-31", None),
    (16, 5, D("0.15"), -100, "violet", "west", False, "2023-01-01", "2023-01-01 18:00:00"),
    (20, 410, D("2.50"), 9, "blue", "west", True, "2024-02-29", "2024-02-29 12:30:44"),
]
LINES = [(1, "red", 12, D("0.50")), (2, "red", 3, D("0.75")), (3, "blue", 7, None), (4, "grey", 2, D("1.00")), (5, None, 9, D("2.00"))]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), ordered=True)
    e.sql("CREATE TABLE rides (metres UINT(32), fare DECIMAL(9, 2), drift SIGNED(32), line MUTEX, depot MUTEX, paid BOOL, day DATE, begun DATETIME)")
    names = ["metres", "fare", "drift", "line", "depot", "paid", "day", "begun"]
    show = lambda v: str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    for i, *values in RIDES:
        there = [(n, v) for n, v in zip(names, values, strict=True) if v is not None]
        e.sql(f"INSERT INTO rides (_record_id, {', '.join(n for n, _ in there)}) VALUES ({i}, {', '.join(show(v) for _, v in there)})")
    frame = spark.createDataFrame(LINES, "id long, line string, stops long, toll decimal(9,2)")
    e.attach("lines", frame, "id")
    return e


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    c.execute("CREATE TABLE rides (id BIGINT, metres BIGINT, fare DECIMAL(9,2), drift BIGINT, line VARCHAR, depot VARCHAR, paid BOOLEAN, day DATE, begun TIMESTAMP)")
    c.executemany("INSERT INTO rides VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", RIDES)
    c.execute("CREATE TABLE lines (id BIGINT, line VARCHAR, stops BIGINT, toll DECIMAL(9,2))")
    c.executemany("INSERT INTO lines VALUES (?, ?, ?, ?)", LINES)
    return c


# a condition of the dialect, and what DuckDB calls it: absent values compare as false, NOT is the complement
CONDITIONS = [
    ("metres >= 640", "coalesce(metres >= 640, false)"),
    ("NOT metres >= 640", "NOT coalesce(metres >= 640, false)"),
    ("metres != 640", "coalesce(metres <> 640, false)"),
    ("drift < 0 AND NOT line = 'blue'", "coalesce(drift < 0, false) AND NOT coalesce(line = 'blue', false)"),
    ("NOT (drift < 0 OR fare = 2.5)", "NOT (coalesce(drift < 0, false) OR coalesce(fare = 2.5, false))"),
    ("line IN ('red', 'violet')", "coalesce(line IN ('red', 'violet'), false)"),
    ("line NOT IN ('red', 'violet')", "NOT coalesce(line IN ('red', 'violet'), false)"),
    ("fare BETWEEN 1.05 AND 3.4", "coalesce(fare BETWEEN 1.05 AND 3.4, false)"),
    ("fare NOT BETWEEN 1.05 AND 3.4", "NOT coalesce(fare BETWEEN 1.05 AND 3.4, false)"),
    ("depot LIKE '%th' OR line ILIKE 'B_ue'", "coalesce(depot LIKE '%th', false) OR coalesce(line ILIKE 'B_ue', false)"),
    ("paid", "coalesce(paid, false)"),
    ("NOT paid = true", "NOT coalesce(paid, false)"),
    ("paid = false", "coalesce(NOT paid, false)"),
    ("day > '2023-04-01'", "coalesce(day > DATE '2023-04-01', false)"),
    ("begun < '1970-01-01'", "coalesce(begun < TIMESTAMP '1970-01-01', false)"),
    ("begun <= now()", "coalesce(begun <= now()::TIMESTAMP, false)"),
    ("day > now()", "coalesce(day > now()::DATE, false)"),
    ("round(fare) = 3", "coalesce(round(fare) = 3, false)"),
    ("round(metres, -2) >= 600", "coalesce(round(metres, -2) >= 600, false)"),
    ("floor(fare) != 2", "coalesce(floor(fare) <> 2, false)"),
    ("ceil(fare) <= 3", "coalesce(ceil(fare) <= 3, false)"),
    ("toYear(day) = 2024", "coalesce(year(day) = 2024, false)"),
    ("toDate(begun) = '2024-02-29'", "coalesce(CAST(begun AS DATE) = DATE '2024-02-29', false)"),
    ("date_trunc('quarter', day) < '2024-01-01'", "coalesce(date_trunc('quarter', day) < DATE '2024-01-01', false)"),
    ("date_trunc('week', begun) >= '2023-04-01'", "coalesce(date_trunc('week', begun) >= TIMESTAMP '2023-04-01', false)"),
    ("_record_id IN (SELECT _record_id FROM lines WHERE stops > 2)", "id IN (SELECT id FROM lines WHERE stops > 2)"),
    ("NOT paid OR _record_id IN (SELECT _record_id FROM lines)", "NOT coalesce(paid, false) OR id IN (SELECT id FROM lines)"),
]


@pytest.mark.parametrize(("ours", "theirs"), CONDITIONS)
def test_conditions(engine, duck, ours, theirs):
    found = duck.sql(f"SELECT id FROM rides WHERE {theirs} ORDER BY id").fetchall()
    assert rows(engine.sql(f"SELECT _record_id FROM rides WHERE {ours}")) == found
    n, total, other = engine.sql(f"SELECT countIf({ours}) AS n, sumIf(drift, {ours}) AS t, count(*) FILTER (WHERE NOT ({ours})) AS o FROM rides").first()
    assert (n, total, other) == duck.sql(f"SELECT count(*) FILTER (WHERE {theirs}), coalesce(sum(drift) FILTER (WHERE {theirs}), 0)::BIGINT, count(*) FILTER (WHERE NOT ({theirs})) FROM rides").fetchall()[0]


STATEMENTS = [
    ("SELECT sum(metres), sum(fare), sum(drift), min(day), max(begun) FROM rides", "SELECT sum(metres)::BIGINT, sum(fare), sum(drift)::BIGINT, min(day), max(begun) FROM rides"),
    ("SELECT avg(metres) FROM rides", "SELECT sum(metres) / count(*) FROM rides"),
    ("SELECT median(metres), quantile(0.25)(fare), quantileExact(0.9)(drift) FROM rides", "SELECT quantile_disc(metres, 0.5), quantile_disc(fare, 0.25), quantile_disc(drift, 0.9) FROM rides"),
    ("SELECT uniq(line), count(DISTINCT depot), count(*) FROM rides", "SELECT count(DISTINCT line), count(DISTINCT depot), count(*) FROM rides"),
    ("SELECT topK(2)(line) FROM rides", "SELECT ['blue', 'red']"),
    ("SELECT line, count(*), sum(metres) FROM rides GROUP BY line", "SELECT line, count(*), coalesce(sum(metres), 0)::BIGINT FROM rides WHERE line IS NOT NULL GROUP BY line ORDER BY line"),
    ("SELECT line, median(drift) AS m FROM rides GROUP BY line", "SELECT line, quantile_disc(drift, 0.5) FROM rides WHERE line IS NOT NULL GROUP BY line ORDER BY line"),
    ("SELECT depot, line, max(fare) FROM rides GROUP BY depot, line", "SELECT depot, line, max(fare) FROM rides WHERE depot IS NOT NULL AND line IS NOT NULL GROUP BY ALL ORDER BY 1, 2"),
    ("SELECT date_trunc('month', day) AS m, count(*) AS n FROM rides GROUP BY date_trunc('month', day)", "SELECT CAST(date_trunc('month', day) AS DATE), count(*) FROM rides WHERE day IS NOT NULL GROUP BY 1 ORDER BY 1"),
    ("SELECT DISTINCT date_trunc('year', day) FROM rides", "SELECT DISTINCT CAST(date_trunc('year', day) AS DATE) AS y FROM rides WHERE day IS NOT NULL ORDER BY y"),
    ("SELECT depot, line, count(*) AS n FROM rides GROUP BY depot, line WITH ROLLUP", "SELECT * FROM (SELECT depot, line, count(*) FROM rides WHERE depot IS NOT NULL AND line IS NOT NULL GROUP BY ALL ORDER BY 1, 2) UNION ALL SELECT * FROM (SELECT depot, NULL, count(*) FROM rides WHERE depot IS NOT NULL GROUP BY 1 ORDER BY 1) UNION ALL SELECT NULL, NULL, count(*) FROM rides"),
    ("SELECT depot, line, sum(fare) AS t FROM rides WHERE metres > 100000 GROUP BY depot, line WITH CUBE", "SELECT NULL, NULL, 0.00::DECIMAL(38,2)"),
    ("SELECT line, sum(drift) AS t, uniq(depot) AS u FROM rides GROUP BY GROUPING SETS ((line), ())", "SELECT * FROM (SELECT line, coalesce(sum(drift), 0)::BIGINT, count(DISTINCT depot) FROM rides WHERE line IS NOT NULL GROUP BY 1 ORDER BY 1) UNION ALL SELECT NULL, sum(drift)::BIGINT, count(DISTINCT depot) FROM rides"),
    ("SELECT line, count(*) AS n FROM rides GROUP BY line HAVING count(*) > 1 AND NOT count(*) > 3 ORDER BY n DESC LIMIT 1 OFFSET 1", "SELECT 'red', 3"),
    ("SELECT line, count(*) AS n FROM rides WHERE depot = 'south' OR depot = 'west' GROUP BY line HAVING count(*) >= 1 ORDER BY count(*) DESC LIMIT 2 WITH TIES", "SELECT line, count(*) AS n FROM rides WHERE depot IN ('south', 'west') GROUP BY line ORDER BY line"),
    ("SELECT depot, metres FROM rides ORDER BY metres DESC LIMIT 3", "SELECT depot, metres FROM rides ORDER BY metres DESC NULLS LAST, id LIMIT 3"),
    ("SELECT metres FROM rides ORDER BY metres LIMIT 9", "SELECT metres FROM rides ORDER BY metres NULLS LAST, id"),
    ("SELECT line FROM rides WHERE drift > 20 UNION ALL SELECT line FROM lines WHERE stops = 2 UNION ALL SELECT depot FROM rides WHERE drift < -99", "SELECT unnest(['red', 'grey', 'west'])"),
    ("SELECT count(*) FROM rides SAMPLE 1/4", "SELECT count(*) FROM rides WHERE id % 4 = 0"),
    ("SELECT metres, rank() OVER (PARTITION BY depot ORDER BY metres DESC) AS r FROM rides WHERE paid LIMIT 4", "SELECT metres, rank() OVER (PARTITION BY depot ORDER BY metres DESC NULLS LAST)::INTEGER FROM rides WHERE paid ORDER BY id LIMIT 4"),
    ("SELECT drift, runningDifference(drift) OVER (ORDER BY drift) AS r FROM rides WHERE drift > -50", "SELECT drift, drift - lag(drift) OVER (ORDER BY drift, id) FROM rides WHERE drift > -50 ORDER BY id"),
    ("SELECT -drift, drift * 2 - 1, metres % 7, metres / 4, metres / 0 FROM rides WHERE metres = 1250", "SELECT -drift, drift * 2 - 1, metres % 7, metres / 4, NULL FROM rides WHERE metres = 1250 ORDER BY id"),
    ("SELECT lower(upper(line)), ltrim(concat(' ', depot)), rtrim(concat(depot, '  ')), ifNull(depot, 'none') FROM rides WHERE line = 'red'", "SELECT line, depot, depot, coalesce(depot, 'none') FROM rides WHERE line = 'red' ORDER BY id"),
    ("SELECT round(log2(metres), 5), log10(metres), round(fare, 1) FROM rides WHERE metres = 640", "SELECT round(log2(metres), 5), log10(metres), round(fare, 1) FROM rides WHERE metres = 640 ORDER BY id"),
    ("SELECT date_add('month', 1, day), date_sub('year', 1, day), date_diff('day', day, toDate('2024-03-01')) FROM rides WHERE toYear(day) = 2024", "SELECT CAST(day + INTERVAL 1 MONTH AS DATE), CAST(day - INTERVAL 1 YEAR AS DATE), date_diff('day', day, DATE '2024-03-01') FROM rides WHERE year(day) = 2024 ORDER BY id"),
    ("SELECT formatDateTime(begun, '%H:%M on %d.%m.%Y|%q') FROM rides WHERE drift = 3", "SELECT '12:30 on 29.02.2024|%q'"),
    ("SELECT ln(drift), log10(drift), exp(drift) FROM rides WHERE drift = 0", "SELECT '-inf'::DOUBLE, '-inf'::DOUBLE, 1.0"),
    ("SELECT number FROM numbers(4)", "SELECT range FROM range(4)"),
    ("SELECT count(*), sum(r.metres), min(s.stops), max(r.fare), count(DISTINCT r.line) FROM rides r JOIN lines s ON r.line = s.line", "SELECT count(*), sum(metres)::BIGINT, min(stops), max(fare), count(DISTINCT r.line) FROM rides r JOIN lines s ON r.line = s.line"),
    ("SELECT count(*), sum(r.drift) FROM rides r LEFT JOIN lines s ON r.line = s.line", "SELECT count(*), sum(drift)::BIGINT FROM (SELECT * FROM rides WHERE line IS NOT NULL) r LEFT JOIN lines s ON r.line = s.line"),
    ("SELECT count(*), sum(s.stops) FROM rides r RIGHT JOIN lines s ON r.line = s.line", "SELECT count(*), sum(stops)::BIGINT FROM rides r RIGHT JOIN (SELECT * FROM lines WHERE line IS NOT NULL) s ON r.line = s.line"),
    ("SELECT count(*), count(DISTINCT r.line) FROM rides r FULL JOIN lines s ON r.line = s.line", "SELECT count(*), count(DISTINCT coalesce(r.line, s.line)) FROM (SELECT * FROM rides WHERE line IS NOT NULL) r FULL JOIN (SELECT * FROM lines WHERE line IS NOT NULL) s ON r.line = s.line"),
    ("SELECT count(*), sum(r.metres) FROM rides r LEFT JOIN lines s ON r.line = s.line WHERE s.stops > 5", "SELECT count(*), sum(metres)::BIGINT FROM rides r JOIN lines s ON r.line = s.line WHERE s.stops > 5"),
    ("SELECT r.line, count(*) AS n FROM rides r JOIN lines s ON r.line = s.line GROUP BY r.line ORDER BY n DESC LIMIT 1", "SELECT 'red', 6"),
    ("SELECT count(*), sum(r.metres) FROM rides r JOIN lines s ON r.depot = s.line", "SELECT 0, 0"),
    ("SELECT sum(metres), min(fare), count(*) FROM rides WHERE line = 'none'", "SELECT 0, NULL, 0"),
]


def spelled(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize(("ours", "theirs"), STATEMENTS)
def test_statements(engine, duck, ours, theirs):
    found = [tuple(map(spelled, r)) for r in rows(engine.sql(ours))]
    assert found == [tuple(map(spelled, r)) for r in duck.sql(theirs).fetchall()]


def test_answers_without_an_order(engine, spark):
    """Without ordered, no sort stands in plans that don't ask for one, and the rows are the same."""
    loose = Engine(spark, engine.store.root)
    for text in ("SELECT line, metres FROM rides WHERE metres > 1", "SELECT line, count(*) FROM rides GROUP BY line", "SELECT line FROM rides UNION ALL SELECT line FROM lines", "SELECT depot, line, count(*) FROM rides GROUP BY depot, line WITH ROLLUP"):
        if "lines" in text:
            loose.attach("lines", spark.createDataFrame(LINES, "id long, line string, stops long, toll decimal(9,2)"), "id")
        out = loose.sql(text)
        assert "Sort [" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(rows(out), key=str) == sorted(rows(engine.sql(text)), key=str)


def test_membership_counts_records_once(spark):
    """Ids that the other table repeats make no record count twice, alone or beside other conditions."""
    e = Engine(spark)
    e.attach("a", spark.createDataFrame([(1, 5, "x"), (2, 6, "y"), (3, 7, "x")], "id long, u long, k string"), "id")
    e.attach("b", spark.createDataFrame([(5, 1), (5, 2), (5, 3), (7, 1)], "id long, v long"), "id")
    for where, n in (("k = 'zz' OR u IN (SELECT _record_id FROM b)", 2), ("u IN (SELECT _record_id FROM b WHERE v < 3)", 2), ("NOT (k = 'y' OR u IN (SELECT _record_id FROM b WHERE v > 1))", 1), ("u NOT IN (SELECT _record_id FROM b)", 1)):
        assert rows(e.sql(f"SELECT count(*) FROM a WHERE {where}")) == [(n,)]
    assert rows(e.sql("SELECT countIf(u IN (SELECT _record_id FROM b)) AS n, count(*) AS m FROM a")) == [(2, 3)]


@pytest.mark.parametrize(
    ("call", "text"),
    [
        ('Count(Intersect(Row(metres > 100), Not(Row(line="red"))))', "SELECT count(*) FROM rides WHERE metres > 100 AND NOT line = 'red'"),
        ('Sum(Union(Row(depot="west"), Row(drift == 0)), field=fare)', "SELECT sum(fare) FROM rides WHERE depot = 'west' OR drift = 0"),
        ('Count(Difference(All(), Row(paid=true), Row(metres=5)))', "SELECT count(*) FROM rides WHERE NOT paid = true AND NOT metres = 5"),
        ('TopN(All(), field="line", n=2)', "SELECT line, count(*) FROM rides GROUP BY line ORDER BY count(*) DESC LIMIT 2"),
        ('GroupByBucket(All(), field=day, unit="quarter", n=9, aggregate=Min(field=drift))', "SELECT date_trunc('quarter', day), min(drift) FROM rides GROUP BY date_trunc('quarter', day)"),
        ('Project(Like(depot="%st"), field=depot, field=drift)', "SELECT depot, drift FROM rides WHERE depot LIKE '%st'"),
        ("Rounded(round, fare >= 3)", "SELECT _record_id FROM rides WHERE round(fare) >= 3"),
        ("Sample(Row(metres >= 1), n=4)", "SELECT _record_id FROM rides WHERE _record_id IN (4, 12, 16, 20)"),
    ],
)
def test_calls(engine, call, text):
    assert rows(engine.pql("rides", call)) == rows(engine.sql(text))


def test_views_and_segments(engine):
    engine.sql("CREATE VIEW far AS SELECT metres, line AS way FROM rides WHERE metres > 600")
    assert rows(engine.sql("SELECT way, count(*) FROM far GROUP BY way")) == [("blue", 1), ("red", 3)]
    assert rows(engine.sql("SELECT count(*) FROM rides WHERE NOT SEGMENT(far)")) == [(4,)]
    assert rows(engine.sql("SHOW VIEWS")) == [("far", "SELECT metres, line AS way FROM rides WHERE metres > 600")]
    for text, code in (("SELECT fare FROM far", "unknown_field"), ("SELECT count(*) FROM lines WHERE SEGMENT(far)", "sql_segment_table"), ("CREATE VIEW far AS SELECT metres FROM rides", "table_exists"), ("CREATE VIEW v AS SELECT count(*) FROM rides", "sql_view_body")):
        with pytest.raises(Refused) as e:
            engine.sql(text)
        assert e.value.code == code


@pytest.fixture
def own(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "own"), ordered=True)
    e.sql("CREATE TABLE stock (pieces UINT(8), labels SET, state ENUM('open', 'sold', 'lost'), seen TIMEQUANTUM)")
    e.sql("INSERT INTO stock (pieces, labels, state) VALUES (30, 'old', 'open'), (200, 'new', 'sold')")
    return e


def test_writes(own, spark):
    assert rows(own.sql("INSERT INTO stock (_record_id, labels, pieces) VALUES (2, 'rare', 7), (9, 'old', 1)")) == [(2,)]
    assert rows(own.sql("SELECT _record_id, pieces, labels, state FROM stock")) == [(1, 30, ["old"], "open"), (2, 7, ["new", "rare"], "sold"), (9, 1, ["old"], None)]
    for values, code in (("(pieces) VALUES (256)", "value_out_of_range"), ("(pieces) VALUES ('many')", "bad_argument"), ("(state) VALUES ('gone')", "unknown_member")):
        with pytest.raises(Refused) as e:
            own.sql(f"INSERT INTO stock {values}")
        assert e.value.code == code
    assert rows(own.sql("UPDATE stock SET state = 'lost', pieces = 2 WHERE labels = 'old'")) == [(2,)]
    with pytest.raises(Refused, match="sql_update_column"):
        own.sql("UPDATE stock SET labels = 'x' WHERE pieces = 2")
    with pytest.raises(Refused, match="sql_delete_too_large"):
        own.sql("DELETE FROM stock WHERE pieces < 100 SETTINGS max_delete_records = 2")
    assert rows(own.sql("DELETE FROM stock WHERE NOT state = 'lost'")) == [(1,)]
    assert rows(own.sql("SELECT _record_id, pieces FROM stock")) == [(1, 2), (9, 2)]
    own.sql("CREATE TABLE twin (amount UINT(32), labels SET)")
    assert rows(own.sql("INSERT INTO twin (amount, labels) SELECT pieces, state FROM stock WHERE pieces > 0")) == [(2,)]
    assert rows(own.sql("SELECT _record_id, amount, labels FROM twin")) == [(1, 2, ["lost"]), (2, 2, ["lost"])]
    with pytest.raises(Refused, match="sql_insert_self_read"):
        own.sql("INSERT INTO twin (amount) SELECT amount FROM twin")
    own.sql("INSERT OVERWRITE TABLE twin (amount) SELECT pieces FROM stock WHERE labels = 'old'")
    assert own.delete_ids("twin", spark.createDataFrame([(1,), (77,)], "id long")) == 1
    assert rows(own.records("twin", limit=5)) == [(2,)] and rows(own.records("twin", after=2)) == []


@pytest.fixture
def many(spark, tmp_path):
    """A managed table of which more than 2^20 records are alike."""
    e = Engine(spark, str(tmp_path / "many"))
    e.attach("given", spark.range(2**20 + 4).selectExpr("id AS size", "CASE WHEN id < 3 THEN 'few' ELSE 'many' END AS state"), "size")
    e.sql("CREATE TABLE goods (size UINT(32), state MUTEX)")
    e.sql("INSERT INTO goods (size, state) SELECT size, state FROM given")
    return e


def test_writes_of_many_records(many):
    n = 2**20 + 1
    for text in ("DELETE FROM goods", "UPDATE goods SET size = 5"):
        with pytest.raises(Refused, match="sql_delete_too_large"):
            many.sql(f"{text} WHERE state = 'many' SETTINGS max_delete_records = {n - 1}")
    assert rows(many.sql("SELECT count(*), max(size) FROM goods")) == [(n + 3, n + 2)]
    assert rows(many.sql("UPDATE goods SET size = 5 WHERE state = 'many'")) == [(n,)]
    assert rows(many.sql("SELECT count(*), sum(size) FROM goods")) == [(n + 3, 5 * n + 3)]
    assert rows(many.sql(f"DELETE FROM goods WHERE state = 'many' SETTINGS max_delete_records = {n}")) == [(n,)]
    many.sql("INSERT INTO goods (size, state) SELECT size, state FROM given")
    assert rows(many.sql("DELETE FROM goods WHERE state = 'many'")) == [(n,)]
    assert sorted(rows(many.sql("SELECT size, state FROM goods"))) == [(i, "few") for i in (0, 0, 1, 1, 2, 2)]


def test_seen_keys(own, spark):
    keys = spark.createDataFrame([("old",), ("none",), ("new",), ("new",), (None,)], "k string")
    assert sorted(r.k for r in own.seen("stock", "labels", keys).collect()) == ["new", "old"]
    assert [r[0] for r in own.seen("stock", "pieces", spark.createDataFrame([(30,), (31,)], "n long")).collect()] == [30]


def test_definitions(own):
    own.sql("ALTER TABLE stock ADD COLUMN weight DECIMAL(6, 1)")
    with pytest.raises(Refused, match="field_exists"):
        own.sql("ALTER TABLE stock ADD COLUMN Weight UINT(8)")
    own.sql("INSERT INTO stock (_record_id, weight) VALUES (1, 4.5)")
    assert rows(own.sql("SELECT pieces, weight FROM stock")) == [(30, D("4.5")), (200, None)]
    own.sql("ALTER TABLE stock DROP COLUMN labels")
    assert [r[0] for r in rows(own.sql("DESCRIBE TABLE stock"))] == ["pieces", "state", "seen", "weight"]
    own.sql("ALTER TABLE stock RENAME TO goods")
    with pytest.raises(Refused, match="unknown_table"):
        own.sql("SELECT count(*) FROM stock")
    own.sql("CREATE TABLE other (pieces UINT(8))")
    own.sql("EXCHANGE TABLES goods AND other")
    assert rows(own.sql("SELECT count(*) FROM other")) == [(2,)] and rows(own.sql("SELECT count(*) FROM goods")) == [(0,)]
    own.sql("TRUNCATE TABLE other")
    assert rows(own.sql("SELECT sum(pieces), count(*) FROM other")) == [(0, 0)]
    own.sql("DROP TABLE goods")
    assert rows(own.sql("SHOW TABLES")) == [("other", "BASE TABLE", "bitmap+columnar", 4)]
    with pytest.raises(Refused, match="database_exists"):
        own.sql("CREATE DATABASE default")
    own.sql("CREATE DATABASE depotdb")
    own.sql("CREATE TABLE depotdb.bins (pieces UINT(8))")
    assert rows(own.sql("SELECT count(*) FROM bins", database="depotdb")) == [(0,)]
    assert rows(own.sql("SELECT name, tables FROM system.databases")) == [("default", 1), ("depotdb", 1)]
    with pytest.raises(Refused, match="database_not_empty"):
        own.sql("DROP DATABASE depotdb")
    own.sql("DROP DATABASE depotdb CASCADE")
    assert rows(own.sql("SHOW DATABASES")) == [("default", 1)]


def seconds(text):
    return int(dt.datetime.fromisoformat(text + "+00:00").timestamp())


def test_days_of_a_time_quantum(own, spark):
    """Windows read the folders of their days alone; days that retention drops are gone, the keys stay."""
    marks = [("shelf", "2022-06-30 23:00:00"), ("shelf", "2022-07-01 01:00:00"), ("till", "2022-07-01 09:00:00"), ("shelf", "2022-07-04 12:00:00")]
    own.sql("INSERT INTO stock (seen) VALUES " + ", ".join(f"('{k}@{seconds(t)}')" for k, t in marks))
    one = lambda text: own.sql(text).first()[0]
    june, july = seconds("2022-06-30 00:00:00"), seconds("2022-07-01 12:00:00")
    assert one("SELECT count(*) FROM stock WHERE seen = 'shelf'") == 3
    assert one(f"SELECT count(*) FROM stock WHERE seen = 'shelf' AND seen >= {july}") == 2
    assert one(f"SELECT count(*) FROM stock WHERE seen = 'shelf' AND seen BETWEEN {june} AND {july}") == 2
    assert one(f"SELECT count(*) FROM stock WHERE NOT (seen = 'shelf' AND seen <= {july}) AND seen = 'shelf'") == 1
    assert one(f"SELECT count(*) FROM stock WHERE state = 'open' OR (seen = 'till' AND seen < {july})") == 2
    plan = own.sql(f"SELECT count(*) FROM stock WHERE seen = 'shelf' AND seen >= {july}")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "ReadSchema: struct<_record_id:bigint>" in plan
    assert sorted(r[0] for r in rows(own.sql("SELECT view FROM system.parts WHERE table = 'stock'")) if r[0] != "standard") == ["standard_20220630", "standard_20220701", "standard_20220704"]
    own.sql("ALTER TABLE stock DROP DAYS BEFORE '2022-07-01' ON seen")
    assert one(f"SELECT count(*) FROM stock WHERE seen = 'shelf' AND seen >= {june}") == 2 and one("SELECT count(*) FROM stock WHERE seen = 'shelf'") == 3
    own.compact("stock")
    assert one(f"SELECT count(*) FROM stock WHERE seen = 'shelf' AND seen >= {june}") == 2 and own.store.vacuum("stock") >= 2
    assert one(f"SELECT count(*) FROM stock WHERE seen = 'shelf' AND seen <= {july}") == 1
    own.sql("ALTER TABLE stock ADD COLUMN moved TIMEQUANTUM")
    assert one(f"SELECT count(*) FROM stock WHERE moved = 'x' AND moved >= {june}") == 0
    # attached tables have arrays of pairs and no folders
    frame = spark.createDataFrame([(1, [("a", dt.datetime(2022, 7, 1, 8)), ("b", None)]), (2, [("a", dt.datetime(2022, 7, 3))]), (3, None)], "id long, v array<struct<key:string,at:timestamp>>")
    own.attach("walks", frame, "id")
    assert one(f"SELECT count(*) FROM walks WHERE v = 'a' AND v <= {july}") == 1


def test_store_is_read_again(engine, spark, tmp_path):
    again = Engine(spark, engine.store.root)
    assert rows(again.sql("SELECT sum(metres) FROM rides")) == [(7250,)]
    engine.compact("rides")
    engine.backup(str(tmp_path / "copy"))
    assert rows(Engine(spark, str(tmp_path / "copy")).sql("SELECT sum(fare), count(*) FROM rides")) == [(D("42.99"), 9)]
    assert engine.store.vacuum("rides") >= 1
    assert rows(engine.sql("SELECT count(*) FROM rides")) == [(9,)]


def test_many_deletes_are_compacted_and_restored(many, spark, tmp_path):
    many.sql("DELETE FROM goods WHERE state = 'many'")
    many.compact("goods")
    assert many.store.vacuum("goods") == 2
    many.backup(str(tmp_path / "copy"))
    many.sql("TRUNCATE TABLE goods")
    assert rows(many.sql("SELECT count(*) FROM goods")) == [(0,)]
    assert sorted(rows(Engine(spark, str(tmp_path / "copy")).sql("SELECT size, state FROM goods"))) == [(0, "few"), (1, "few"), (2, "few")]


def test_two_writers(own, spark):
    other = Engine(spark, own.store.root)
    own.sql("CREATE TABLE first (a SET)")
    with pytest.raises(Refused, match="catalog_changed"):
        other.sql("CREATE TABLE second (a SET)")
    other.store.load()
    other.sql("DROP TABLE first")
    own.store.load()
    assert [r[0] for r in rows(own.sql("SHOW TABLES"))] == ["stock"]


def test_facts(own, tmp_path):
    own.sql("CREATE TABLE f (tag SET, worth DECIMAL(8, 2), pulse TIMEQUANTUM, size UINT(32))")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.txt").write_text("worth 4 900\ntag 4 late  word\n")
    (tmp_path / "in" / "a.txt").write_text("tag 4 x\nworth 4 125\n\n  worth 5 7 \npulse 5 k@1656633600\nworth 4 130\n")
    assert own.import_facts("f", str(tmp_path / "in")) == 7
    # of several values the last line's holds, in files by name
    assert rows(own.sql("SELECT _record_id, worth FROM f")) == [(4, D("9.00")), (5, D("0.07"))]
    assert sorted(rows(own.sql("SELECT tag, count(*) FROM f GROUP BY tag"))) == [("late  word", 1), ("x", 1)]
    (tmp_path / "bad.txt").write_text("hue 1 red\n")
    with pytest.raises(Refused, match="unknown_field"):
        own.import_facts("f", str(tmp_path / "bad.txt"))
    (tmp_path / "bad.txt").write_text("tag 1\n")
    with pytest.raises(Exception, match="bad_fact"):
        own.import_facts("f", str(tmp_path / "bad.txt"))


def test_loads_go_on_where_they_stopped(own, spark, tmp_path):
    own.sql("CREATE TABLE f (size UINT(32), tag SET)")
    for k in range(5):
        (tmp_path / f"{k}.txt").write_text(f"size {k} {k * 10}\nsize 100 {k}\n" if k != 3 else "size three 3\n")
    with pytest.raises(Exception, match="three"):
        own.load_facts("f", str(tmp_path), "nightly", chunk_bytes=1)
    assert rows(own.sql("SELECT _record_id, size FROM f")) == [(0, 0), (1, 10), (2, 20), (100, 2)]
    (tmp_path / "3.txt").write_text("size 3 33\n")
    again = Engine(spark, own.store.root, ordered=True)
    assert again.load_facts("f", str(tmp_path), "nightly", chunk_bytes=40) == 3
    assert rows(again.sql("SELECT _record_id, size FROM f")) == [(0, 0), (1, 10), (2, 20), (3, 33), (4, 40), (100, 4)]
    assert again.load_facts("f", str(tmp_path), "nightly") == 0
    (tmp_path / "5.txt").write_text("tag 4 new\n")
    assert again.load_facts("f", str(tmp_path), "nightly") == 1 and again.load_facts("f", str(tmp_path), "other") == 10


def test_catalog_and_plans(engine):
    assert ("default", "rides", "fare", "decimal") in [r[:4] for r in rows(engine.sql("SELECT * FROM system.columns WHERE table = 'rides'"))]
    assert rows(engine.sql("SELECT count FROM system.parts WHERE table = 'rides'"))[0] == (8,)
    assert ("default", "rides", "BASE TABLE", "bitmap+columnar", 8) in rows(engine.sql("SELECT * FROM system.tables"))
    with pytest.raises(Refused, match="sql_system_clause"):
        engine.sql("SELECT name FROM system.tables ORDER BY name")
    assert "fare DECIMAL(9, 2)" in rows(engine.sql("SHOW CREATE TABLE rides"))[0][0]
    assert rows(engine.sql("SHOW PROCESSLIST")) == []
    lines = [r[0] for r in engine.sql("EXPLAIN SELECT count(*) FROM rides WHERE metres >= 600 AND NOT paid").collect()]
    assert lines[:3] == ["plan #0", "Count rides", "└── intersect"]


def test_roles(engine):
    engine.sql("CREATE ROLE reader")
    engine.sql("GRANT SELECT ON rides TO reader")
    assert rows(engine.sql("SHOW ROLES")) == [("reader",)] and rows(engine.sql("SHOW GRANTS FOR reader"))[0][2] == "select"
    assert rows(engine.sql("SELECT count(*) FROM rides", role="reader")) == [(9,)]
    for text in ("SELECT count(*) FROM lines", "DELETE FROM rides WHERE metres = 5", "SELECT count(*) FROM rides WHERE metres IN (SELECT _record_id FROM lines)", "GRANT ALL ON * TO reader"):
        with pytest.raises(Refused, match="forbidden"):
            engine.sql(text, role="reader")
    engine.sql("REVOKE SELECT ON rides FROM reader")
    with pytest.raises(Refused, match="forbidden"):
        engine.sql("SELECT count(*) FROM rides", role="reader")
    engine.sql("DROP ROLE reader")
    with pytest.raises(Refused, match="unknown_role"):
        engine.sql("DROP ROLE reader")


def test_formats_and_limits(engine):
    text = "SELECT line, fare FROM rides ORDER BY fare LIMIT 2 FORMAT "
    assert engine.render(text + "CSVWithNames") == "line,fare\nviolet,0.15\nblue,1.05\n" and engine.render(text + "CSV") == "violet,0.15\nblue,1.05\n"
    assert engine.render(text + "TSV") == engine.render(text + "TabSeparated") == "violet\t0.15\nblue\t1.05\n"
    assert engine.render(text + "TSVWithNames") == engine.render(text + "TabSeparatedWithNames") == "line\tfare\nviolet\t0.15\nblue\t1.05\n"
    assert '"data": [{"line": "violet", "fare": "0.15"}' in engine.render(text + "JSON") and '"data": [["violet", "0.15"]' in engine.render(text + "JSONCompact")
    assert engine.render("SELECT line FROM rides WHERE metres = 2975 FORMAT CSV") == "\\N\n"
    assert engine.bound("SELECT count(*) FROM rides WHERE line = ? AND metres > ?", ["r'd", 5]) == "SELECT count(*) FROM rides WHERE line = 'r''d' AND metres > 5"
    with pytest.raises(Refused, match="result_too_large"):
        engine.sql("SELECT line FROM rides SETTINGS max_result_rows = 8")
    assert len(engine.collect("SELECT line FROM rides SETTINGS max_execution_time = 60")) == 9


def test_statements_are_stopped(engine, spark):
    import threading
    import time

    from pyspark.sql import functions as F

    slow = spark.range(8).repartition(8).select("id", F.udf(lambda x: time.sleep(20) or x, "long")("id").alias("v"))
    engine.attach("slow", slow, "id")
    with pytest.raises(Refused, match="query_cancelled"):
        engine.collect("SELECT sum(v) FROM slow SETTINGS max_execution_time = 1")
    threading.Timer(1.5, lambda: engine.sql("KILL QUERY 'mine'")).start()
    with pytest.raises(Refused, match="query_cancelled"):
        engine.collect("SELECT max(v) FROM slow", query_id="mine")


def test_exact_quantile_by_narrowing(spark):
    from tallyhouse.operators.grouping import exact_quantile

    df = spark.range(30_000).selectExpr("cast((id * 6_151) % 30000 as long) as v".replace("_", ""))
    for level, expected in ((D("0"), 0), (D("0.25"), 7_499), (D("0.5"), 14_999), (D("0.999"), 29_969), (D("1"), 29_999)):
        assert exact_quantile(df, "v", level) == expected
    assert exact_quantile(df.where("v < 0"), "v", D("0.5")) is None


def test_group_quantile_by_brackets(spark, monkeypatch):
    """Groups of every size, one of them with most of the rows, also where the sketch is too coarse to hold the rank."""
    from tallyhouse.operators import grouping

    e = Engine(spark, ordered=True)
    frame = spark.range(40_000).selectExpr("id", "case when id % 10 > 2 then 'hot' when id % 10 = 1 then 'mid' else concat('g', id % 700) end as g", "cast((id * 7919) % 40000 as decimal(12,2)) / 7 as x").selectExpr("id", "g", "cast(x as decimal(12,2)) as v")
    e.attach("q", frame, "id")
    local = frame.toPandas()
    for level in ("0", "0.3", "0.5", "0.99", "1"):
        want = {g: sorted(own)[max(1, -(-len(own) * round(float(level) * 100) // 100)) - 1] for g, own in local.groupby("g")["v"]}
        assert dict(rows(e.sql(f"SELECT g, quantile({level})(v) AS m FROM q GROUP BY g"))) == want
    monkeypatch.setattr(grouping, "SKETCH", 2)
    assert dict(rows(e.sql("SELECT g, quantile(1)(v) AS m FROM q GROUP BY g"))) == want


def test_json_members(spark):
    e = Engine(spark, ordered=True)
    docs = ['{"n": 12}', '{"n": "12"}', '{"deep": {"n": "q"}, "n": -3}', '{"n": 0.25}', '{"n": null}', "no json", None, '{"n": {"z":[1]}}', '{"n": 4, "n": "x"}', '{"n": "4", "n": 5}', '{"n": 1} x', '[{"n": 1}]', '{"n": true}']
    e.attach("j", spark.createDataFrame(list(enumerate(docs)), "id long, doc string"), "id")
    found = rows(e.sql("SELECT JSONExtractInt(doc, 'n'), JSONExtractString(doc, 'n'), JSONExtractFloat(doc, 'n'), JSONHas(doc, 'n'), JSONExtractRaw(doc, 'n') FROM j"))
    assert [r[0] for r in found] == [12, None, -3, None, None, None, None, None, 4, None, None, None, None]
    assert [r[1] for r in found] == [None, "12", None, None, None, None, None, None, None, "4", None, None, None]
    assert [r[2] for r in found] == [12.0, None, -3.0, 0.25, None, None, None, None, 4.0, None, None, None, None]
    assert [r[3] for r in found][:10] == [1, 1, 1, 1, 1, 0, 0, 1, 1, 1]
    assert found[7][4] == '{"z":[1]}'


def test_dbapi(engine):
    from tallyhouse import dbapi

    with dbapi.connect(engine) as connection:
        cursor = connection.cursor()
        cursor.execute("SELECT line, metres FROM rides WHERE metres > ?", [1000])
        assert [d[0] for d in cursor.description] == ["line", "metres"] and cursor.description[0][1] == dbapi.STRING and cursor.description[1][1] == dbapi.NUMBER != dbapi.DATETIME
        assert cursor.fetchone() == ("red", 1250) and len(cursor.fetchmany(1)) == 1 and len(cursor.fetchall()) == 1
        named = cursor.execute("SELECT count(*) FROM rides WHERE line = %(line)s AND NOT depot = '%(line)s' AND metres < %(most)s", {"most": 1000, "line": "red"})
        assert named.fetchall() == [(1,)]
        for text, kind, code in (("USE elsewhere", dbapi.ProgrammingError, "sql_use_unsupported"), ("SELECT line FROM rides SETTINGS max_result_rows = 1", dbapi.OperationalError, "result_too_large"), ("CREATE TABLE rides (a SET)", dbapi.IntegrityError, "table_exists"), ("INSERT INTO rides (metres) VALUES (-1)", dbapi.DataError, "value_out_of_range")):
            with pytest.raises(kind) as e:
                cursor.execute(text)
            assert e.value.code == code and isinstance(e.value, dbapi.Error)
        with pytest.raises(dbapi.NotSupportedError):
            connection.rollback()
    with pytest.raises(dbapi.InterfaceError):
        cursor.execute("SELECT count(*) FROM rides")
