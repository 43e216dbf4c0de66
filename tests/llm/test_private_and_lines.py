import hashlib
import re

from pyspark.sql import functions as F

from alphaloom.llm import decontaminate, linededup, pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return 8 <= len(d) <= 15 if kind == "phone" else True


TEXTS = [
    None, "", "nothing here", "a@b.c", "x a.b+c@mail.example.com_d@e.f, y@z", "@@ a@b a@b. é@ü.de", "bo@b@c.d.e-f",
    "1.2.3.4.5.6.7.8 300.1.1.1 1.1.1.256 0001.2.3.4 1.2.3", "call +1 (555) 010-9999 or +49 30 1234567 8 +1-2 +123",
    "4111 1111 1111 1111 and 4111-1111-1111-1111 4111111111111111 4111111111111112 41111111111111111111 1-2 3 4",
    "€ 😀 mail me@x.org 😀 +1 555 0109999", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" ok", "9" * 5000, "a" * 20000,
    "id 5555555555554444, 5 555555555554444", "+" * 50 + "1 2", ("u%d@h.io " * 200) % tuple(range(200)), "a@b.c_x@d.e.f+y@g.h",
    "192.168.0.1\n10.0.0.1\t8.8.8.8",
]


def test_base_spans_equal_plain_patterns(frame):
    df = frame(list(enumerate(TEXTS)) + [(3, TEXTS[3])])
    out = pii.detected(df, pii.fit(df)).select("doc_id", "counts.*", pii.as_text(F.filter("spans", lambda c: c["kind"].isin(*pii.BASE))).alias("s"),
                                                pii.as_text(F.col("spans")).alias("every"))
    seen = out.collect()
    assert len(seen) == len(TEXTS) + 1
    for r in seen:
        text = TEXTS[r.doc_id] or ""
        want = [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text) if valid(k, m[0])]
        assert r.s == ",".join(want), r.doc_id
        assert [r.email, r.ip, r.card, r.phone] == [sum(w.startswith(k) for w in want) for k in BASE]
    assert any("secret:9:49" in r.every for r in seen)


def test_votes_decide_added_spans(frame):
    hexes = [hashlib.sha1(bytes([i])).hexdigest() for i in range(40)]
    rows = [(i, f'x token = "{h}" y') for i, h in enumerate(hexes)]
    rows += [(100 + i, f"see {'abcdefghij' * 3}xyz{chr(97 + i % 26)} there") for i in range(40)]
    df = frame(rows)
    model = pii.fit(df)
    assert set(model.weights) == {"secret"}
    got = {r.doc_id for r in pii.detected(df, model).where(F.size("spans") > 0).collect()}
    assert got == set(range(40))
    none = pii.fit(df.limit(0))
    assert none.weights == {}
    assert pii.detected(df, none).where(F.size("spans") > 0).count() == 0


def test_long_secrets_are_proposed(frame):
    hexes = [(hashlib.sha512(bytes([i])).hexdigest() * 50)[:n] for i, n in enumerate([24, 40, 128, 129, 200, 5000] * 6)]
    df = frame([(i, f'x token = "{h}" y') for i, h in enumerate(hexes)] + [(100, "token = " + "a1" * 11 + "b, " + "é" + "c3" * 300 + "ß")])
    out = pii.detected(df, pii.fit(df)).select("doc_id", pii.as_text(F.col("spans")).alias("s"), *[
        F.transform(pii.candidates(F.col("text"))["secret"], lambda c: c["start"]).alias("starts")])
    got = {r.doc_id: r for r in out.collect()}
    for i, h in enumerate(hexes):
        assert got[i].s == f"secret:11:{11 + len(h)}"
    assert got[100].starts == [34]


def test_repeated_chunks_go_and_first_stays(frame):
    passage = "\n".join(f"shared line {k} of the passage" for k in range(12))
    rows = [(i, f"own start {i}\nmore {i}\nmuch more {i}\n{passage}\nown end {i}\nlast {i}") for i in range(6)]
    rows += [(10, None), (11, ""), (12, "one line"), (13, "one line"), (14, "\n\n\n\n"), (15, "\n\n\n\n"), (None, passage), (4, rows[4][1])]
    df = frame([(a, b, 0, "k") for a, b in rows], "doc_id long, text string, n_lines int, rid string")
    out = linededup.without_repeats(df)
    assert out.columns == ["doc_id", "text", "rid", "n_lines", "n_removed", "n_chunks"]
    got = [r.asDict() for r in out.collect()]
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["text"] == passage and by[None]["n_removed"] == 0  # a NULL id comes first
    for i in range(6):
        assert 6 <= by[i]["n_removed"] <= 12
        assert f"own start {i}" in by[i]["text"] and f"last {i}" in by[i]["text"]
        assert len(by[i]["text"].split("\n")) == by[i]["n_lines"] - by[i]["n_removed"]
    assert [r["n_removed"] for r in got if r["doc_id"] == 4] == [by[4]["n_removed"]] * 2
    for i, text in rows[6:12]:
        assert by[i]["text"] == text and by[i]["n_removed"] == 0
    assert linededup.without_repeats(df.limit(0)).count() == 0


def test_short_passages_go_and_shorter_runs_stay(frame):
    line = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    one, two, three = line("a", 51), line("b", 26) + "\n" + line("c", 25), "\n\n".join(line(t, 18) for t in "def")
    short, items = line("g", 50), "\n".join(f"item {k}" for k in range(40))
    rows = []
    for i, passage in enumerate([one, two, three, short, items]):
        for j in range(3):
            d = 10 * i + j
            rows.append((d, f"{line(f'x{d}_', 9)}\n{passage}\n\n{line(f'y{d}_', 9)}\nbye {d}"))
    # the lines of a passage in another order, each known from elsewhere, are no passage
    rows.append((100, "\n".join(reversed(three.split("\n\n")))))
    df = frame([(a, b, "n", 1.0) for a, b in rows], "doc_id long, text string, N_Lines string, R2 double")
    out = linededup.without_repeats(df)
    assert out.columns == ["doc_id", "text", "R2", "n_lines", "n_removed", "n_chunks"]
    by = {r.doc_id: r for r in out.collect()}
    text = dict(rows)
    for d in by:
        stays = d % 10 == 0 or d // 10 == 3 or d == 100
        assert (by[d].text == text[d]) == stays, d
        if not stays and d // 10 != 4:
            assert by[d].text == f"{line(f'x{d}_', 9)}\n{line(f'y{d}_', 9)}\nbye {d}"
    assert all(by[d].n_removed >= 38 for d in (41, 42))


def test_line_dedup_of_a_very_long_text(frame):
    text = "\n".join(f"line number {k} of a long text with enough words in it" for k in range(20_000))
    got = {r.doc_id: r for r in linededup.without_repeats(frame([(1, text), (2, "new\n" + text), (3, "x")])).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 20_000 and got[2].text == "new" and got[3].text == "x"


def brute_leaks(docs, items):
    def cut(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    return sorted(
        {(d, i, len(cut(q)), len(cut(q) & cut(t))) for d, t in docs for i, q in items if cut(q) and 5 * len(cut(q) & cut(t)) >= 4 * len(cut(q))}, key=repr
    )


def test_leaks_equal_exact_containment(frame, rows, prose):
    w = prose.split()
    items = [(0, " ".join(w[:30])), (1, " ".join(w[10:22])), (2, "a b c"), (3, None), (4, ""), (5, " ".join(f"w{k}" for k in range(300))), (None, " ".join(w[5:25]))]
    changed = w[:30]
    changed[15] = "CHANGED"
    docs = [
        (0, prose), (1, "x " * 3000 + " ".join(w[:30]).upper() + " y" * 3000), (2, "a b c"), (3, "A  B\nC d"), (4, None), (5, ""), (6, " ".join(changed)),
        (7, " ".join(f"w{k}" for k in range(290))), (8, " ".join(w[12:21])), (8, prose), (None, prose), (9, "nothing of the kind here at all today"),
    ]
    got = decontaminate.leaks(frame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int"), frame(items, "item_id long, text string"))
    assert rows(got, "doc_id", "item_id", "n_shingles", "n_shared") == brute_leaks(docs, items)
    kept = decontaminate.clean(frame(docs), frame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {x[0] for x in brute_leaks(docs, items)}
    assert decontaminate.leaks(frame(docs), frame([], "item_id long, text string")).count() == 0
    assert decontaminate.leaks(frame([]), frame(items, "item_id long, text string")).count() == 0
