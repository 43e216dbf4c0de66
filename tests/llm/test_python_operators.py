import base64
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from alphaloom.llm import bpe, chat, jaccard, licenses, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n", "don't I'LL", "a" * 3000, "😀" * 200, "<|endoftext|>", "ab" * 700 + " " * 300, "naïve 12345 ÀÉ", "x\x00y"]


@pytest.fixture(scope="session")
def theirs():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="session")
def ours():
    return bpe.Encoder(bpe.Vocabulary(PATH, public_tokenizers.PATTERN))


def test_bpe_query_equals_the_library(frame, theirs):
    out = bpe.encoded(frame([(i, t, "z") for i, t in enumerate(ODD)], "doc_id long, text string, ids string"), PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    for r in out.collect():
        text = ODD[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert bytes(r.decoded).decode() == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_bpe_round_trip(ours, theirs, texts):
    got = ours.encode(texts)
    assert [g.tolist() for g in got] == [theirs.encode_ordinary(t) for t in texts]
    assert [ours.decode(g).decode() for g in got] == texts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="us\\\n<|im_start>n[/INST]", max_size=20), st.text(alphabet="\\n<|im_end>/s[INST] \n", max_size=60)), max_size=6))
def test_chat_reads_back(turns):
    style = chat.MarkedTurns()
    done = chat.render(turns, style)
    back = chat.read_back(done.text)
    assert back.turns == turns and not done.rewrites
    assert "".join(done.text[a:b] for a, b in done.spans) == done.text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", ""]), st.text(alphabet="\\n<|im_end>/s[INST] \n", max_size=60)), max_size=6))
def test_chat_loss_is_cut_from_the_spans(turns):
    style = chat.MarkedTurns()
    done = chat.render(turns, style)
    loss = chat.loss_spans(done, turns, style)
    assert [chat.unescape(done.text[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]
    moved = chat.Formatted(done.text, [(a + 1, b) for a, b in done.spans], False)
    if loss:
        with pytest.raises(ValueError, match="spans of the prefixes"):
            chat.loss_spans(moved, turns, style)


def test_chat_detects_rewritten_history(frame):
    def forgetful(turns):
        return "".join(f"[{r}]{t}" for r, t in turns[-2:])

    def last_marked(turns):
        return "".join(f"({t})" if i + 1 < len(turns) else f"({t})!" for i, (_, t) in enumerate(turns))

    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert chat.render(turns, forgetful).rewrites and chat.render(turns, last_marked).rewrites
    assert not chat.render(turns[:2], forgetful).rewrites
    assert chat.render(turns, last_marked).spans == [(0, 3), (3, 6), (6, 10)]
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (None, 0, None, "x"), (1, 1, "assistant", None), (2, None, "user", "")]
    got = {r.conv_id: r for r in chat.digests(chat.formatted(frame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 3, None: 1, 2: 1}
    assert got[1].loss_chars == 0
    assert chat.formatted(frame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_alignment(doc, template):
    """Best local alignment without a band: matched words."""
    best, found = 0, 0
    before = [(0, 0)] * (len(doc) + 1)
    for t in template:
        row = [(0, 0)]
        for p, w in enumerate(doc):
            s, m = before[p]
            cell = (s + 2, m + 1) if w == t else (s - 1, m)
            cell = max(cell, (before[p + 1][0] - 1, before[p + 1][1]), (row[-1][0] - 1, row[-1][1]), (0, 0))
            row.append(cell)
            if cell[0] > best:
                best, found = cell
        before = row
    return found


def test_licenses_against_full_alignment(frame, prose):
    rnd = random.Random(1)
    norm = lambda t: [licenses._normal(w.encode()).lower() for w in t.split()]
    texts = [None, "", " ", prose, "license " * 400]
    for name, template in licenses.TEMPLATES.items():
        w = template.split()
        if len(w) >= 12:
            del w[len(w) // 2]
            w.insert(3, "extra")
            w[7] = "other"
        texts.append(prose + "\n" + " ".join(w).upper() + " " + prose)
        texts.append(" ".join(w[: len(w) // 2]) + " " + " ".join(rnd.sample(prose.split(), 20)))
    got = defaultdict(dict)
    for r in licenses.scan(frame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, start string")).collect():
        got[r.doc_id][r.template] = r
        assert texts[r.doc_id][r.start : r.end].strip() == texts[r.doc_id][r.start : r.end]
    for i, t in enumerate(texts):
        full = {n: brute_alignment(norm(t or ""), norm(x)) / len(norm(x)) for n, x in licenses.TEMPLATES.items()}
        for n, r in got[i].items():
            assert r.coverage == pytest.approx(full[n])
        strong = {n for n, c in full.items() if c >= 0.8}
        assert bool(strong) == bool(got[i]), (i, strong)
    assert licenses.scan(frame([])).count() == 0


def test_repeated_notices_are_reported_each(frame):
    short = {n: t for n, t in licenses.TEMPLATES.items() if len(t.split()) <= 24}
    assert {len(t.split()) for t in short.values()} >= {3, 5, 12}
    texts, want = [], []
    for name, template in short.items():
        for times in (2, 7, 40):
            for gap in ("", "and ", "one two three "):
                texts.append(("x " + gap + template + " ") * times if gap else (template + " ") * times)
                step, first = len(texts[-1]) // times, len("x " + gap) if gap else 0
                want.append([(name, first + k * step) for k in range(times)])
    texts.append("All rights X reserved. All rights reserved. filler " + "Licensed under CC BY 4.0. All rights reserved. " * 3)
    want.append(None)
    got = defaultdict(list)
    for r in licenses.scan(frame(list(enumerate(texts)))).collect():
        got[r.doc_id].append((r.template, r.start))
    for i, w in enumerate(want):
        if w is not None:
            assert sorted(got[i], key=lambda x: x[1]) == w, (i, texts[i][:80])
    last = [n for n, _ in sorted(got[len(texts) - 1], key=lambda x: x[1])]
    assert last == ["Proprietary/notice"] * 2 + ["CC-BY-4.0/notice", "Proprietary/notice"] * 3


def brute_links(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root, links = {i: i for i in texts}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i), links[i]) for i in texts)


def near_copies(seed, groups, size, length, edits):
    rnd = random.Random(seed)
    texts = {}
    for g in range(groups):
        base = [f"w{rnd.randrange(400)}" for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randrange(edits + 1)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            texts[len(texts)] = " ".join(w)
    return texts


@pytest.mark.parametrize("limits", [(1024, 1 << 21), (16, 400)])
def test_jaccard_equals_brute_force(frame, rows, monkeypatch, limits):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", limits[0])
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", limits[1])
    texts = near_copies(2, 12, 6, 60, 4) | {1000 + k: v for k, v in near_copies(3, 1, 130, 50, 4).items()}  # one group over the rare limit
    texts |= {2000: None, 2001: "", 2002: " \n", 2003: "a b", 2004: "A  b", 2005: "a b c d", 2006: "one", 2007: "x " * 400, 2008: "x " * 90}
    texts |= {3000 + k: " ".join(f"s{j}" for j in range(k, k + 9)) for k in range(6)}
    df = frame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, node int", 4)
    got = jaccard.linked(df)
    assert rows(got, "doc_id", "n_shingles", "component_id", "n_links") == sorted(brute_links(texts), key=repr)


def test_jaccard_edge_rows(frame, rows, prose):
    got = jaccard.linked(frame([(None, prose), (5, prose), (5, prose), (3, prose + " end"), (None, None), (9, "")]))
    n = len(prose.split()) - 4
    assert rows(got, "doc_id", "n_shingles", "component_id", "n_links") == sorted(
        [(None, n, 3, 3), (5, n, 3, 3), (5, n, 3, 3), (3, n + 1, 3, 3), (None, 0, None, 0), (9, 0, 9, 0)], key=repr
    )
    assert jaccard.linked(frame([])).count() == 0


def test_reach_of_frequent_pairs():
    n = np.arange(2, 200_000)
    d, e, _ = jaccard.prefix_length(n)
    # the partner of a set of n tokens has n / 0.8 at most, so at most n // 4 unshared tokens
    gaps = (d + n // 4) // e + 2
    assert gaps.max() - 1 <= jaccard.REACH


def test_toxicity_learns_planted_words(frame, prose):
    rnd = random.Random(4)
    words = prose.split()
    rows, labels = [], []
    for i in range(400):
        w = [rnd.choice(words) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            w.insert(rnd.randrange(40), rnd.choice(["vile", "nasty!", "AWFUL"]))
        rows.append((i, " ".join(w), 7.0))
        labels.append((i, int(toxic)))
    docs = frame(rows + [(900, None, 1.0), (901, "", 1.0), (None, "vile", 1.0)], "doc_id long, text string, score double")
    train = frame(labels[:300] + [(None, 1), (7777, 1), (900, 1)], "doc_id long, toxic int")
    weights = toxicity.fit(docs, train)
    assert 0 < len(weights) < 200
    out = {r.doc_id: r for r in toxicity.scored(docs, weights).collect()}
    assert len(out) == 403 and all(0 <= r.score <= 1 for r in out.values())
    assert [out[i].predicted for i in range(300, 400)] == [t for _, t in labels[300:]]
    assert out[900].score == out[901].score < 0.5
    blank = toxicity.scored(docs, toxicity.fit(docs, train.limit(0)))
    assert {r.score for r in blank.collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), weights).count() == 0
