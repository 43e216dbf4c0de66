"""URL filters, ranked lexical search and the conversation trie against plain Python."""
import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.llm import lexical, queries, trie, urlfilter

DATA = Path("/root/testdata/sf0.001")

# --- URL filters ---------------------------------------------------------------------------


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path, rules):
    fits = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return max(fits, default=(0, None, None))[1:]


URLS = [
    None, "", "no scheme", "http://", "http:///", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y=/net/#z", "https://a.www.example.com/en/",
    "https://b.example.com/en/1", "https://badexample.com/en/1", "https://x.net/es/1", "https://x.net/ES/1", "https://x.net?/es/1", "x://y://z.net/fr/#",
    "https://ÄÖ.net/es/ü", "https://x.net/es/" + "long" * 5000, "https://x.net/es/1", "https://a.b.c.d.e.f.net/fr/2", "https://com.org/en/", "://com/en/",
]


def test_hosts_paths_and_rules(spark, frame):
    rows = frame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    out = urlfilter.judged(rows, queries.URL_RULES, np.zeros((1 << 16) + 1)).collect()
    assert len(out) == len(URLS)
    for r in out:
        assert (r.host, r.path) == plain_parts(r.url)
        rule, verdict = plain_rule(r.host, r.path, queries.URL_RULES)
        assert r.rule == rule and r.verdict == (verdict or "allow") and r.score == 0.5


def test_url_model_on_held_out_urls(spark, frame):
    rng = np.random.default_rng(1)
    langs, tlds = ["en", "de", "fr", "es"], ["com", "net", "org"]
    urls = [f"https://{'www' if rng.uniform() < .5 else 'm'}.{rng.choice(['foo', 'bar', 'baz'])}.example.{rng.choice(tlds)}/{rng.choice(langs)}/{i}" for i in range(1500)]
    pages = frame(list(enumerate(urls)), "page_id long, url string")
    labelled = urlfilter.labelled_by_rules(pages, queries.URL_RULES)
    said = dict(map(tuple, labelled.collect()))
    assert said == {u: int(v == "block") for u in urls for v in [plain_rule(*plain_parts(u), queries.URL_RULES)[1]] if v}
    config = urlfilter.Config(max_rows=300)
    weights = urlfilter.fit(labelled, config=config)
    judged = urlfilter.judged(pages, [], weights, config=config).collect()
    assert all(r.rule is None for r in judged)
    known = [(said[r.url], r.verdict == "block") for r in judged if r.url in said]
    assert np.mean([a == b for a, b in known]) > 0.97 and len(known) > 700
    again = urlfilter.fit(labelled.repartition(5), config=config)
    np.testing.assert_array_equal(weights, again)


def test_url_filter_edges(spark, frame):
    rows = frame([(1, "http://x.org/a", "p", 5.0)] * 2 + [(None, None, None, None)], "page_id long, url string, Path string, Score double")
    none = urlfilter.fit(rows.select("url").withColumn("label", F.lit(None).cast("int")))
    assert not none.any()
    out = urlfilter.judged(rows, queries.URL_RULES, none)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "score", "verdict"] and out.count() == 3
    assert {(r.verdict, r.score) for r in out.collect()} == {("allow", 0.5)}
    assert urlfilter.judged(rows.limit(0), queries.URL_RULES, none).count() == 0
    one = urlfilter.fit(rows.select("url").withColumn("label", F.lit(1)))
    assert urlfilter.judged(rows, [], one).where("url IS NOT NULL AND verdict = 'block'").count() == 2
    with pytest.raises(ValueError):
        urlfilter.Rules([("nohost", "block")])


@pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")
def test_op11_columns(spark):
    out = queries.op11_url_filters(spark, str(DATA)).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url").collect()}
    assert len(out) == len(urls)
    for r in out:
        host, path = plain_parts(urls[r.page_id])
        rule, verdict = plain_rule(host, path, queries.URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


# --- ranked search --------------------------------------------------------------------------


def plain_terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def plain_search(docs, items, top):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(plain_terms(t))
    out = {}
    for i, own in terms.items():
        scored = []
        for (doc, c), n in zip(counts, sizes):
            s = 0
            for t in own:
                if c[t]:
                    m = 50 + 50 * n * n_docs // total
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out[i] = [(None if none else doc, -s) for s, none, doc in sorted(scored)[:top]]
    return {i: r for i, r in out.items() if r}


def found(df):
    rows = {}
    for r in df.collect():
        rows.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    for r in rows.values():
        assert sorted(x[0] for x in r) == list(range(1, len(r) + 1))
    return {i: [x[1:] for x in sorted(r)] for i, r in rows.items()}


def corpus(seed=3, n=400):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    p = 1 / np.arange(1, 301)
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=p / p.sum()))) for i in range(n)]
    docs += [(1000 + i, docs[5][1]) for i in range(150)] + [(7, docs[7][1]), (7, docs[7][1]), (None, docs[9][1]), (2000, None), (2001, ""), (2002, "... !")]
    items = [(i, " ".join(rng.choice(words, 8))) for i in range(12)] + [(3, "w200 W201"), (50, docs[5][1]), (None, "w1 w250"), (60, "unseen"), (61, None), (62, "")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_pairs": 20, "head": 0.3}, {"head": 1.0}])
def test_search_equals_brute_force(spark, frame, monkeypatch, options):
    monkeypatch.setattr(lexical, "FIRST_ROWS", 3)
    docs, items = corpus()
    got = found(lexical.ranked(frame(docs), frame(items, "item_id long, text string"), top=10, **options))
    assert got == plain_search(docs, items, 10)


def test_buckets_lose_no_row_that_reaches_the_floor():
    rng = np.random.default_rng(0)
    size = 40
    rows = [np.sort(rng.choice(size, rng.integers(1, 15), replace=False)) for _ in range(200)]
    owner = np.repeat(np.arange(200), [len(r) for r in rows])
    term = np.concatenate(rows)
    impact = rng.integers(1, 10**6, len(term))
    norm = np.sqrt(np.bincount(owner, impact.astype(float) ** 2))
    bucket = lexical.Bucket(list(range(200)), norm, owner, term, impact, size)
    dense = np.zeros((200, size), np.int64)
    dense[owner, term] = impact
    pruned = 0
    for _ in range(50):
        t = rng.choice(size, 9, replace=False)
        q = lexical.Query(t, rng.integers(1, 9000, 9))
        scores = dense[:, q.terms] @ q.weights
        for floor in (0, int(np.sort(scores)[-20]), int(scores.max()), int(scores.max()) + 1):
            near, exact = bucket.reach(q, floor) if q.rest[0] * bucket.longest >= floor else (np.empty(0, int), np.empty(0, int))
            assert (scores[near] == exact).all() and set(np.flatnonzero(scores >= max(floor, 1))) <= set(near.tolist())
            pruned += len(near) < (scores > 0).sum()
    assert pruned > 100


def test_search_edges(spark, frame, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    assert [t for p in lexical.pieces("Ab-c_é9 ÄB\x7fx" * 9) for t in p] == [t.encode() for t in plain_terms("Ab-c_é9 ÄB\x7fx" * 9)]
    docs, items = frame([(1, "a b c"), (2, "a")]), frame([(1, "c")], "item_id long, text string")
    empty = docs.limit(0)
    assert lexical.ranked(empty, items).count() == 0 and lexical.ranked(docs, items.limit(0)).count() == 0
    assert lexical.ranked(docs, frame([(1, None)], "item_id long, text string")).count() == 0
    clash = docs.withColumns({"norm": F.lit(1), "Terms": F.lit("x"), "at": F.lit(2), "score": F.lit(3)})
    assert found(lexical.ranked(clash, items)) == plain_search([(1, "a b c"), (2, "a")], [(1, "c")], 50)
    long = [(1, "common " * 50_000 + "rare"), (2, "rare")]
    assert found(lexical.ranked(frame(long), frame([(1, "rare common")], "item_id long, text string"))) == plain_search(long, [(1, "rare common")], 50)


# --- trie ---------------------------------------------------------------------------------------


def plain_turns(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    return {c: [t[3] for t in sorted(r)] for c, r in own.items()}


def plain_rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = Counter(k[:-1] for k in members if k)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), kids[k], sum(kids[x] == 0 for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
DDL = "conv_id long, turn long, role string, text string"


def node_rows(df):
    return sorted((tuple(r) for r in df.select(*NODE).collect()), key=repr)


def talk(seed=2, n=130):
    """Branching, copied, growing and long conversations."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        shape = c % 5
        turns = [f"t{rng.integers(0, 3)}" for _ in range(rng.integers(1, 7))] if shape < 3 else ["same a", "same b"] if shape == 3 else [f"g {i}" for i in range(c // 5)]
        rows += [(c, i, "user" if i % 2 == 0 else None, t) for i, t in enumerate(turns)]
    rows += [(-45, i, "x", f"deep {i % 4}") for i in range(90)] + [(-40, i, "x", f"deep {i % 4}") for i in range(85)]
    return rows + [(-3, None, "user", "t1"), (-3, 0, "user", None), (-3, 0, "user", None), (-3, 0, None, "b"), (None, 0, "user", "lost"), (5, 0, "user", "again")]


@pytest.mark.parametrize("container", [1, 12, 256, 10**6])
def test_trie_equals_brute_force(spark, frame, monkeypatch, container):
    monkeypatch.setattr(trie, "SEGMENT", 8)
    rows = talk()
    assert node_rows(trie.prefix_trie(frame(rows, DDL), container=container)) == plain_trie(plain_turns(rows))


@pytest.mark.parametrize("container", [1, 40])
def test_rebuilt_trie_equals_brute_force(spark, frame, container):
    rows = [r for r in talk() if r[0] is None or r[0] % 7]  # some first conversations are absent
    own = trie.turns(frame(rows, DDL)).cache()
    got = trie.nodes(*trie.rebuilt(own), container=container)
    assert node_rows(got) == plain_trie(plain_rebuilt(plain_turns(rows)))
    assert got.where("depth > 0").count() == got.where("parent_node IS NOT NULL AND turn_id IS NOT NULL").count()
    own.unpersist()


def test_trie_edges(spark, frame, monkeypatch):
    monkeypatch.setattr(trie, "REPEATS", 4)
    assert trie.prefix_trie(frame([], DDL)).count() == 0
    assert trie.prefix_trie(frame([(None, 1, "a", "b")], DDL)).count() == 0
    rows = [(1, 1, "user", "same words")] * 11 + [(2, 1, "user", "same words")] * 9
    clash = frame(rows, DDL).withColumns({"depth": F.lit(1), "K1": F.lit(2), "words": F.lit(3), "n": F.lit(4)})
    assert node_rows(trie.prefix_trie(clash, container=4)) == plain_trie(plain_turns(rows))
