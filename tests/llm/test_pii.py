"""Spans against the patterns themselves, disclosure on a small corpus, replaced texts."""

import hashlib
import random
import re

import pytest

from maskwright.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_patterns(seed):
    rng = random.Random(seed)
    bits = ["a", "b.c", "@", "@x", ".", "..", "-", "+", "+1", " ", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1111", "10.0.0.1", "256.1.1.1.1", "\n", "é", "7", "99", "0", "x@y.z", "@@", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), text
    number = "".join(rng.choice("0123456789") for _ in range(5000))
    assert pii.base_spans(number) == [] and pii.base_spans("0" * 5000 + ".1.2.3") == [(0, 1, 5006)]


def test_documents_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    n = 0
    for r in docs.collect():
        spans = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain(r.text))
        n += bool(spans)
        own = got[r.doc_id]
        assert own.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(own.spans.split(","))
        assert own.n_email + own.n_ip + own.n_card + own.n_phone == len(plain(r.text))
    assert n > 10


def test_words_that_disclose(spark):
    mail = "zed@corp.example.com"
    telling = [f"w{k} x{k} Quibblethorpe {mail} and y{k} z{k}." for k in range(5)]
    other = [f"and the of w{k} m{k}@mail.example.com and then" for k in range(400)]
    rows = [(i, t, "x") for i, t in enumerate([*telling, telling[0], None, "", *other, "and of the"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(4)
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    for i, t in list(enumerate(telling)) + [(5, telling[0])]:
        at = t.index("Quibblethorpe")
        assert f"term:{at}:{at + 13}" in got[i].split(",") and got[i].count("term") == 1
    assert not any("term" in s for i, s in got.items() if i > 5) and got[6] == got[7] == ""
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert clean[0].text == "w0 x0 [REDACTED] [EMAIL] and y0 z0." and clean[6].text is None and clean[0].spans == "x"
    assert clean[len(rows) - 1].text == "and of the"


def test_telling_words_far_from_the_value_and_without_it(spark):
    mail, signature = "zed@corp.example.com", "kind regards to you all from"
    far = [f"a{k} Quibblethorpe b{k} c{k} d{k} e{k} f{k} g{k} h{k}. {signature} {mail} with best wishes for the week. Quibblethorpe! i{k}" for k in range(20)]
    alone = "met quibblethorpe, on the way"
    copies = [f"Vexley {' '.join(f'u{k}' for k in range(60))} n{i} vex@copy.example.com" for i in range(3)]
    other = [f"{signature} m{k}@mail.example.com with best wishes for the week" for k in range(3000)]
    rows = list(enumerate([*far, alone, *copies, *other]))
    got = {r.doc_id: r.spans.split(",") for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i, t in rows[:20]:
        assert [x for x in got[i] if "term" in x] == [f"term:{m.start()}:{m.end()}" for m in re.finditer("Quibblethorpe", t)]
    assert got[20] == ["term:4:17"]
    assert not any("term" in x for i in range(21, len(rows)) for x in got[i])  # near copies of one text tell nothing


def test_empty_table_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "call +1 (456) 555-2186"), (1, "a@b.co"), (1, "a@b.co")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.spans) for r in pii.find(docs).collect()) == [("1", "email:0:6"), ("1", "email:0:6"), ("None", "phone:5:22")]
    assert pii.find(docs.where("false")).count() == 0


def plain_terms(texts):
    """Telling words of the whole corpus, pair by pair, from the rule alone."""
    texts = sorted({t or "" for t in texts})
    words, values, least = {}, {}, {}
    for t in texts:
        spans = plain(t)
        free = [(m.group().strip(pii.EDGE), m.start() + len(m.group()) - len(m.group().lstrip(pii.EDGE))) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        own = [w.lower() for w, at in free if any(c.isalpha() for c in w) and all(e <= at or s >= at + len(w) for s, _, e in spans)]
        words[t], values[t] = set(own), {(k, t[s:e].lower()) for s, k, e in spans}
        triples = {" ".join(own[k : k + 3]) for k in range(max(1, len(own) - 2))}
        digests = [hashlib.blake2b(x.encode(), digest_size=32).digest() for x in triples]
        least[t] = [min(int.from_bytes(d[8 * k : 8 * k + 8], "little", signed=True) for d in digests) for k in range(4)]
    out = set()
    for v in {v for s in values.values() for v in s}:
        holding = [t for t in texts if v in values[t]]
        for w in {w for t in holding for w in words[t]}:
            both, having = [t for t in holding if w in words[t]], sum(w in words[t] for t in texts)
            different = sum(len({least[t][k] for t in both}) for k in range(4)) / 4
            share = len(both) / having
            if len(both) >= 3 and different >= 2.5 and share >= 0.5 and share * len(texts) / len(holding) >= 2**6 and len(holding) <= len(texts) / 2**6:
                out.add(w)
    return out


@pytest.mark.parametrize("sent", [pii.BROADCAST_BYTES, 0])
def test_disclosure_by_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(pii, "BROADCAST_BYTES", sent)
    rng = random.Random(8)
    names = [f"Name{chr(97 + k)}" for k in range(12)]
    filler = [f"f{k}" for k in range(300)]
    texts = []
    for k in range(1500):
        body = [rng.choice(filler) for _ in range(rng.randint(4, 12))]
        if k < 60:  # a name mostly goes with its own address, now and then with another
            who = rng.randrange(12)
            body.insert(rng.randrange(len(body)), names[who] + rng.choice(["", ",", "!"]))
            if rng.random() < 0.8:
                body.insert(rng.randrange(len(body)), f"box{who if rng.random() < 0.9 else 0}@corp.example.com")
        texts.append(" ".join(body))
    texts += texts[:40] + [None, ""]
    want = plain_terms(texts)
    assert len(want) > 3
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, found_spans string, found int").repartition(4)
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        marked = [t[int(s) : int(e)].lower() for kind, s, e in (x.split(":") for x in got[k].split(",") if x) if kind == "term"]
        assert marked == [w.lower() for w in (x.strip(pii.EDGE) for x in t.split()) if w.lower() in want]
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert all(clean[k].found_spans == "x" and clean[k].found == 1 for k in clean)
    assert all((clean[k].text is None) == (t is None) and not any(w in (clean[k].text or "").lower().split() for w in want) for k, t in enumerate(texts))
