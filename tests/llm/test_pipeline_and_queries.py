"""The pipeline against SQL and brute force, stage by stage, and every opN query that SQL can check."""
import hashlib
import re
import zlib
from pathlib import Path

import base64
import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from alphaloom.llm import bpe, decontaminate, linededup, pii, quality, toxicity
from tools.check_oracle import TABLES, canon

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def least_of_groups(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in texts if find(i) == i}


def test_pipeline_equals_brute_force(spark, con):
    mask = quality.POLICIES["web-2"].mask
    con.execute(f"CREATE TABLE s1 AS SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM ({quality.measured_sql()}) WHERE failures & {mask} = 0)")
    con.execute(f"CREATE TABLE s2 AS SELECT doc_id, new_text AS text FROM ({linededup.repeats_sql('s1')}) WHERE regexp_matches(new_text, '[^\\x20\\x09-\\x0D]')")
    kept = least_of_groups(dict(con.execute("SELECT doc_id, text FROM s2").fetchall()))
    con.execute("CREATE TABLE s3 AS SELECT * FROM s2 WHERE doc_id IN (SELECT unnest(?))", [sorted(kept)])
    left = con.execute(f"SELECT doc_id, text FROM s3 WHERE doc_id NOT IN (SELECT doc_id FROM ({decontaminate.leaks_sql('s3')}))").fetchall()
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, text in left:
        ids = b"".join(x.to_bytes(4, "little") for x in bpe.encode_ordinary(text))
        want[i] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    rows = corpus_pipeline.run(spark, str(DATA)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want and len(rows) == len(want)


def test_stages_keep_the_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        assert out.columns == list(corpus_pipeline.COLUMNS) and out.count() == 0


def test_stages_take_nulls_and_repeats(spark, prose):
    rows = [(1, prose, "en", None, 3), (1, prose, "en", None, 3), (None, prose + " and more", None, "s", None), (2, None, None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(DATA))
    assert {r.doc_id for r in docs.collect()} == {1}


def test_stages_and_operators_take_clashing_columns(spark, prose):
    extra = {n: F.lit("kept") for n in ("d", "C", "leaked", "Rid", "r2", "Gone", "runs", "Stays", "h", "I")}
    rows = [(i, " ".join(f"{w}{i}" for w in prose.split()), "en", "s", 3) for i in range(4)] + [(9, " ".join(f"{w}1" for w in prose.split()) + " x", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(extra)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(DATA))
        assert docs.columns == [*corpus_pipeline.COLUMNS, *extra]
    assert sorted(r.doc_id for r in docs.collect()) == [0, 1, 2, 3] and docs.where(" AND ".join(f"{n} = 'kept'" for n in extra)).count() == 4
    few = docs.select("doc_id", "text").withColumns({"Spans": F.lit(1), "COUNTS": F.lit(2), "Score": F.lit(3), "IDS": F.lit(4), "Decoded": F.lit(5)})
    assert pii.detected(few, pii.fit(few)).columns == ["doc_id", "text", "Score", "IDS", "Decoded", "spans", "counts"]
    assert toxicity.scored(few, {}).select("score", "predicted").distinct().count() == 1
    coded = bpe.encoded(few, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert all(bytes(r.decoded).decode() == r.text for r in coded.collect())


def test_wrappers_of_op2_op3_op4_and_op8(spark, con):
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    run = lambda n: {r.doc_id: r for r in next(q for k, q in entry.queries().items() if k.startswith(f"op{n}_"))(spark, str(DATA)).collect()}
    toxic = run(2)
    assert set(toxic) == set(texts) and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in toxic.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in toxic.values())
    for i, r in run(3).items():
        spans = [s.split(":") for s in r.spans.split(",") if s]
        base = [s for s in spans if s[0] in pii.BASE]
        assert hashlib.sha256(",".join(":".join(s) for s in base).encode()).hexdigest() == r.base_sha256
        assert [sum(s[0] == k for s in base) for k in pii.BASE] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
    sharded = run(4)
    slots = {}
    for i, r in sharded.items():
        data = (texts[i] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for i, r in run(8).items():
        assert r.decoded_sha256 == hashlib.sha256((texts[i] or "").encode()).hexdigest() and (r.n_tokens > 0) == bool(texts[i])


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if re.match(r"op\d+_", n)))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
