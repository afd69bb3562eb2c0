"""The pipeline, stage by stage, on a small table, and the registered queries."""

import random
import re

import pytest
from test_corpus_operators import VOCABULARY, components_by_hand
from test_text_operators import base_by_hand, measures_by_hand

import __spark_entry__
from tallyhouse.llm import packing, secrets, shared
from tallyhouse.llm.queries import oracle_sql, queries
from tallyhouse.llm.shared import kept

corpus_pipeline = pytest.importorskip("corpus_pipeline")
D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, n = docs.columns, docs.count()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near dedup", "secret scans", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = kept(stage(spark, docs, D))
        assert docs.columns == columns and docs.count() <= n, name
        n = docs.count()
        assert docs.select("doc_id").distinct().count() == n
    assert n > 100
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}
    again = corpus_pipeline.run(spark, D).collect()
    total = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert sum(r.length for r in again) == sum(r.length for r in packed) and {r.doc_id for r in again} == {r.doc_id for r in packed}
    assert len(total(again)) > 0


def test_empty_and_odd_rows_pass_through(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c " * 30 + "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "en", "s", 1), (3, "a b c " * 30 + "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "en", "s", 1), (None, "x " * 80, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = kept(stage(spark, docs, D))
    got = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == {1, 2, 3, None} and got[3].endswith("token = [SECRET]") and got[1] is None
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars"), D).count() == 0


def test_registered(spark):
    assert {f"op{n}_" for n in range(1, 11)} == {name.split("_")[0] + "_" for name in queries()}
    assert set(oracle_sql()) <= set(queries()) <= set(__spark_entry__.queries())
    assert "pipeline" in __spark_entry__.queries()


def raw_documents():
    """Good and repetitive texts, copies under other ids and under their own, lines of many sites, secrets, and odd rows."""
    r = random.Random(83)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    shared = [" ".join(word() for _ in range(9)) for _ in range(3)]
    out = []
    for i in range(160):
        kind = r.random()
        if kind < 0.2 and out:
            text = r.choice(out)[1]
        elif kind < 0.4 and out:
            words = (r.choice(out)[1] or "a b").split(" ")
            words[r.randrange(len(words))] = word()
            text = " ".join(words)
        elif kind < 0.5:
            text = " ".join([word(), word()] * r.randint(10, 60))
        else:
            text = "\n".join(" ".join(word() for _ in range(r.randint(20, 60))) for _ in range(r.randint(1, 4)))
        if r.random() < 0.3:
            text += "\n" + r.choice(shared)
        if r.random() < 0.15:
            text += f" {r.choice(['token', 'password', 'secret'])}: {''.join(r.choice('abcdef0123456789') for _ in range(30))}"
        out.append((i // 2 if r.random() < 0.1 else i, text, "en", f"s{r.randrange(8)}", len(text)))
    return [*out, (900, None, None, None, None), (901, "", "en", "s1", 0), out[5], out[5], (902, "one " * 70_000, "en", "s2", 1)]


def test_run_against_plain_python(spark, tmp_path):
    """The whole pipeline, stage on stage, without labels, so that the base rules alone judge."""
    rows = raw_documents()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = [x for x in rows if (m := measures_by_hand(x[1]))[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    assert 40 < len(docs) < len(rows)
    sites, first = {}, {}
    for x in docs:
        for at, line in enumerate(x[1].split("\n")):
            if bare := line.strip(" "):
                sites.setdefault(bare, set()).add(x[3])
                first.setdefault(bare, []).append((x[0], at, x[1]))
    stage = corpus_pipeline.STAGES
    got = kept(stage[1][1](spark, kept(stage[0][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))), str(tmp_path)))
    cut = [(x.doc_id, x.text) for x in got.collect()]
    assert len(cut) == len(docs)
    wide = {line for line, s in sites.items() if len(s) >= 5}
    assert wide
    for line in wide:
        # of each line the first place alone stays: once, or in every row that repeats that document
        holders = {(d, t) for d, t in cut if line in [y.strip(" ") for y in t.split("\n")]}
        assert {d for d, _ in holders} == {min(d for d, *_ in first[line])}
    flat = sorted(x for d, t in cut for x in t.split("\n") if x.strip(" ") not in wide)
    assert flat == sorted(x for d in docs for x in d[1].split("\n") if x.strip(" ") not in wide)

    one = kept(stage[2][1](spark, got, str(tmp_path))).collect()
    pairs = list(dict.fromkeys(cut))
    group = components_by_hand([(i, t) for i, (_, t) in enumerate(pairs)], 5, 80)
    by_group = {}
    for (d, t), (_, _, component) in zip(pairs, group, strict=True):
        by_group.setdefault(component, []).append((d, t))
    assert len(one) == len(by_group) < len(pairs)
    stay = {(x.doc_id, x.text) for x in one}
    for own in by_group.values():
        assert len(stay & set(own)) == 1 and {d for d, t in own if (d, t) in stay} == {min(d for d, _ in own)}

    clean = kept(stage[3][1](spark, spark.createDataFrame(one, columns), str(tmp_path))).collect()
    assert sorted((x.doc_id, x.text) for x in clean) == sorted((x.doc_id, secrets.masked(x.text)) for x in one)
    hidden = 0
    for x in one:
        base = base_by_hand(x.text)
        after = next(y.text for y in clean if y.doc_id == x.doc_id and y.text.split(" ")[0] == x.text.split(" ")[0] and secrets.masked(x.text) == y.text)
        for start, kind, end in base:
            value = x.text[start:end] if kind else re.split(r"[:=]\x20*[\"']?", x.text[start:end], maxsplit=1)[1]
            assert value not in after
            hidden += 1
        assert base or x.n_chars == next(y.n_chars for y in clean if y.text == after and y.doc_id == x.doc_id)
    assert hidden > 3

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {}
    for x in clean:
        texts.setdefault(x.doc_id, []).append(packing.encoder(VOCABULARY, 1).encode([x.text])[0].tolist())
    single = {d: ids[0] for d, ids in texts.items() if len(ids) == 1}
    assert {x.doc_id for x in packed} == set(texts) and sum(x.length for x in packed) == sum(len(i) for ids in texts.values() for i in ids)
    sequences = {x.sequence_id for x in packed}
    totals = {q: sum(x.length for x in packed if x.sequence_id == q) for q in sequences}
    assert all(n == 2048 or n < 2048 and n & (n - 1) == 0 for n in totals.values())
    for d, ids in single.items():
        assert sorted((x.start, x.doc_tokens) for x in packed if x.doc_id == d)[0] == (0, len(ids))


def test_python_gets_batches_of_bounded_bytes(spark):
    # before, a batch had up to 10,000 rows and 64 MB, in the JVM and in the worker, beside the heap
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    rows = spark.range(0, 1500, 1, 1).selectExpr("id", "repeat(cast(id % 10 as string), 10000) as text")
    held = lambda part: {"id": part.column(0), "bytes": [part.column(1).buffers()[2].size] * part.num_rows}  # noqa: E731  a slice has its batch's buffers
    found = shared.map_slices(rows, held, "id long, bytes long").collect()
    assert sorted(r.id for r in found) == list(range(1500))
    assert max(r.bytes for r in found) <= 2 * shared.BATCH_BYTES


def test_lower_batch_limits_stay(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, "1m")
    shared.map_slices(spark.range(1).selectExpr("id", "'' as text"), lambda x: {"id": x.column(0)}, "id long")
    assert spark.conf.get(name) == "1m"
    spark.conf.unset(name)


def test_workers_give_back_what_packing_remembers(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string").coalesce(1)
    remembered = lambda part: {"n": [packing.encoder.cache_info().currsize] * part.num_rows}
    for _ in range(3):  # whichever workers are idle
        assert packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 1
        assert [r.n for r in shared.map_slices(docs, remembered, "n long").collect()] == [0]
