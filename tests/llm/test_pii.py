import hashlib
import math
import random
import re
import time
import unicodedata

import xxhash

from paceline.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def slow(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 16 <= len(d) <= 19 and luhn(d),
                "phone": lambda: 8 <= len(d) <= 15,
            }[kind]
            if good():
                out.append((kind, m.start(), m.end()))
    return out


def texts():
    rng = random.Random(6)
    out = ["", None, "ä a@b.c_x@d.e é 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.03.4", "x@a.b.y@c.d. a@b@c.d", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (202) 555-0143 +49 30 1234567 +1 2", "1" * 3000, "é" * 10 + "+12345678"]
    for alphabet in ("a.@-_1 ", "12.. +-()", "0123456789 -", "é@a.b%+ 1"):
        out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    return out


def test_base_spans(spark):
    rows = [(i, t, "z") for i, t in enumerate(texts())] + [(None, "a@b.c", "z"), (2, "x", "z"), (2, "x", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, email string")
    got = pii.digest(docs).collect()
    joined = lambda t: ",".join("%s:%d:%d" % s for s in slow(t))
    want = sorted((i or -1, hashlib.sha256(joined(t).encode()).hexdigest(), sum(s[0] == "phone" for s in slow(t))) for i, t, _ in rows)
    assert sorted((r.doc_id or -1, r.base_sha256, r.n_phone) for r in got) == want
    assert all(r.spans.startswith(joined(rows[r.doc_id][1])) for r in got if r.doc_id not in (None, 2))
    assert pii.digest(docs.limit(0)).count() == 0


def test_very_long_runs(spark):
    rows = [(1, "a" * 200_000 + " " + "1" * 50_000), (2, "1." * 4_000), (3, "a@" * 20_000), (4, "+" + "1 " * 30_000)]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) for i in (1, 2, 3, 4)] == [(0,) * 4, (0, 1000, 0, 0), (0,) * 4, (0,) * 4]


def disclosing(spark):
    rng = random.Random(9)
    word = lambda: "w%s" % "".join(rng.choice("abcdefghij") for _ in range(3))
    fill = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{fill(9)} Zorblax wrote bo@mail.org {fill(9)} ZORBLAX {fill(5)}") for i in range(6)]
    rows += [(10 + i, f"{fill(20)} wrote {fill(20)}") for i in range(30)]
    rows += [(50 + i, f"{fill(5)} copied secretword of al@mail.org") for i in range(1)] * 1
    copy = f"{fill(5)} alone quuxword of cy@mail.org {fill(4)}"
    rows += [(60 + i, copy) for i in range(20)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_terms_that_disclose(spark):
    rows, docs = disclosing(spark)
    got = {r.doc_id: r for r in pii.digest(docs).collect()}
    for i, text in rows:
        terms = [tuple(map(int, s.split(":")[1:])) for s in got[i].spans.split(",") if s.startswith("term:")]
        assert terms == ([m.span() for m in re.finditer("zorblax", text, re.I)] if i < 6 else []), (text, got[i])
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("orblax" not in clean[i].lower() and "<email>" in clean[i] for i in range(6))
    assert all(clean[i] == t for i, t in rows if 10 <= i < 50) and clean[60] == rows[-1][1].replace("cy@mail.org", "<email>")


def test_terms_of(spark):
    text = "(Zorblax), 'a-b'  x ... É1!\nuser_77@ \t- end. "
    frame = spark.createDataFrame([(text,), ("...",), ("",), (None,), ("a" + "." * 50_000 + "b",), ("(x",)], "t string")
    got = [r[0] for r in frame.select(pii.terms_of(frame["t"])).collect()]
    assert got == [["zorblax", "a-b", "x", "é1", "user_77", "end"], [], [], [], ["a" + "." * 50_000 + "b"], ["x"]]


def test_terms_with_marks_and_digits(spark):
    rng = random.Random(10)
    fill = lambda n: " ".join("w" + "".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    shapes = ["(Zorblax)", "Zorblax,", "zorblax.", "Zorblax's", "ZORBLAX", '"zorblax"']
    rows = [(i, f"{fill(4)} {x} case-4711b, di@mail.org and eve@mail.org. {fill(4)} ({x}) {fill(20)} xzorblaxx") for i, x in enumerate(shapes)]
    docs = spark.createDataFrame(rows + [(10 + i, fill(30)) for i in range(30)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    for i, text in rows:
        assert not re.search(r"(?i)\bzorblax\b", clean[i]) and "4711" not in clean[i] and "zorblaxx" in clean[i], clean[i]
        assert clean[i].count("<email>") == 2
    spans = [s for r in pii.digest(docs).collect() for s in r.spans.split(",") if s.startswith("term")]
    assert len(spans) > 12


def test_sanitised_text(spark):
    docs = spark.createDataFrame([(1, "é a@b.c, 1.2.3.4 +12345678, 4111111111111111.", 1), (2, None, 1), (None, "x@y.z", 1), (4, "+4111111111111111 a", 1)], "doc_id long, text string, key int")
    got = {r.doc_id: (r.text, r.key) for r in pii.sanitise(docs).collect()}
    assert got == {1: ("é <email>, <ip> <phone>, <card>.", 1), 2: (None, 1), None: ("<email>", 1), 4: ("+<card> a", 1)}


def slow_disclosing(rows):
    """``(entity, term)`` by counting documents one by one."""
    inner = lambda c: c.isalnum() or unicodedata.category(c).startswith("M")

    def terms(text):
        out = []
        for w in re.split("[ \t\n\x0b\x0c\r]+", text.lower()):
            at = [i for i, c in enumerate(w) if inner(c)]
            out += [w[at[0] : at[-1] + 1]] if at else []
        return out

    beside, holders, holds = {}, {}, {}
    for n, (_, text) in enumerate(rows):
        text = text or ""
        for t in set(terms(text)):
            holds[t] = holds.get(t, 0) + 1
        blank = list(text)
        for _, start, end in slow(text):
            blank[start:end] = "\n" * (end - start)
        blank = "".join(blank)
        mine = {}
        for kind, start, end in slow(text):
            e = f"{kind}:{text[start:end]}"
            holders.setdefault(e, set()).add(n)
            near = tuple(dict.fromkeys(t for t in terms(blank[max(0, start - 80) : start] + "\n" + blank[end : end + 80]) if len(t) > 2))
            for t in near:
                mine.setdefault((e, t), []).append(near)
        for pair, contexts in mine.items():
            beside.setdefault(pair, []).append(min(contexts, key=context_hash))
    found = set()
    for (e, t), contexts in beside.items():
        ic = -math.log2(len(holders[e]) / len(rows))
        if len(set(contexts)) >= pii.SUPPORT and ic > 0 and ic + math.log2(len(contexts) / holds[t]) >= pii.DISCLOSURE * ic:
            found.add((e, t))
    return found


def context_hash(terms):
    """Spark's hash of a list: each element is hashed with the hash before as the seed."""
    h = 42
    for t in terms:
        h = xxhash.xxh64_intdigest(t.encode(), h)
    return h - 2**64 if h >= 2**63 else h


def test_disclosing_terms_against_slow_counts(spark):
    rng = random.Random(21)
    people = {f"p{i}@mail.org": f"nick{i}" for i in range(6)}
    rows = []
    for i in range(300):
        words = ["v%03d" % rng.randrange(400) for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.choice([0, 0, 1, 1, 3])):
            mail, nick = rng.choice(list(people.items()))
            words[rng.randrange(len(words)) :][:0] = [rng.choice([nick, nick.upper() + ",", "wrote"]), mail]
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice([nick, nick.upper() + ",", "wrote"]), mail]
        if rng.random() < 0.03:
            words.append(rng.choice(list(people.values())))
        rows.append((i, " ".join(words)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (7, rows[7][1]), (7, rows[7][1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = pii.base_spans(docs)
    got = {(r.entity, r.term) for r in pii.disclosing_terms(base, docs).collect()}
    assert got == slow_disclosing(rows) and got


def test_a_term_that_is_common_elsewhere_stays(spark):
    """One document says the address three times beside a word that others hold without it."""
    fill = lambda i: " ".join(f"f{i}x{k}" for k in range(30))
    text = " ".join(f"kestrel z{k} bo@mail.org y{k} {fill(k)}" for k in range(3))
    rows = [(1, text), (2, "kestrel " + fill(8)), (3, fill(9) + " kestrel")] + [(10 + i, fill(20 + i)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.disclosing_terms(pii.base_spans(docs), docs).count() == 0
    assert all("kestrel" in r.text for r in pii.sanitise(docs).where("doc_id < 4").collect())


def test_very_many_spans_in_one_text(spark):
    """Time grows with the length of the text, not with its square."""
    text = " ".join(f"é u{i}@m{i % 7}.org 10.0.{i % 256}.{i % 200} x" for i in range(8_000))
    docs = spark.createDataFrame([(1, text), (2, "a" * 9000 + " q@r.st " + "é" * 9000)], "doc_id long, text string")
    begin = time.time()
    got = {r.doc_id: r for r in pii.digest(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert time.time() - begin < 120
    assert got[1].base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in slow(text)).encode()).hexdigest()
    assert clean[1] == " ".join(["é <email> <ip> x"] * 8_000) and clean[2] == "a" * 9000 + " <email> " + "é" * 9000


def test_columns_of_any_name_stay(spark):
    names = ["_id", "_key", "_k", "_spans", "id", "key", "k", "spans", "beside", "email", "term"]
    rows = [(1, "a@b.c", *range(len(names))), (2, "x", *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "<email>", *range(len(names))), rows[1]]
    assert pii.sanitise(docs.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    for out in (pii.digest(docs), pii.sanitise(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
