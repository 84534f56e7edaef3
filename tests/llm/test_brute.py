"""Operators without SQL against plain second implementations, and on hostile input."""

import gzip
import hashlib
import math
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from samples import frame, odd_rows, words
from tokenizers import Tokenizer

from strandwise.llm import decontaminate, edits, fingerprint, mixing, pseudo, substring, tokens, toxicity, warc
from strandwise.llm.text import Words, window_hashes

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
NONE = -(1 << 63)


def thue_morse(n, a="a", b="e"):
    return "".join((a, b)[k.bit_count() & 1] for k in range(n))


@pytest.mark.parametrize("n", [64, 65, 1024, 4096])
def test_structured_words_have_different_hashes(n):
    docs = [thue_morse(n).encode(), thue_morse(n, "e", "a").encode(), thue_morse(n).encode()]
    for seed in (0, 1):
        h = Words(docs).hashes(seed)
        assert h[0] == h[2] != h[1]
    sequence = [" ".join(thue_morse(n, *x)) for x in ("ae", "ea")]
    a, b = (window_hashes(Words([s.encode()]).hashes(), n) for s in sequence)
    assert len(a) == len(b) == 1 and a[0] != b[0]


def test_hash_depends_on_bytes_alone():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\0é ") for _ in range(rng.randrange(300))).encode() for _ in range(300)]
    w = Words(texts)
    spans = [bytes(w.buf[a:b]) for a, b in zip(w.starts, w.ends, strict=True)]
    h = dict(zip(spans, w.hashes().tolist(), strict=True))
    assert len(set(h.values())) == len(h)
    alone = sorted(h)
    assert Words(alone).hashes().tolist() == [h[s] for s in alone]


@pytest.mark.parametrize("n", [1024, 4096])
def test_encoder_tells_structured_spans_apart(n):
    docs = [thue_morse(n), thue_morse(n, "e", "a"), "plain " + thue_morse(n)]
    ids, counts = tokens.Encoder(WORD_BPE).encode([d.encode() for d in docs])
    want = [Tokenizer.from_file(WORD_BPE).encode(d, add_special_tokens=False).ids for d in docs]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


def test_encoder_survives_shared_hashes(monkeypatch):
    real = tokens.span_hashes
    monkeypatch.setattr(tokens, "span_hashes", lambda buf, a, b, seed=0: real(buf, a, b, seed) & np.uint64(3 if seed == 0 else (1 << 64) - 1))
    rng = random.Random(4)
    docs = [words(rng, 50) for _ in range(20)]
    enc = tokens.Encoder(WORD_BPE)
    want = [Tokenizer.from_file(WORD_BPE).encode(d, add_special_tokens=False).ids for d in docs]
    for _ in range(2):
        ids, counts = enc.encode([d.encode() for d in docs])
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


def brute_repeats(rows, size):
    """Rows of one id come in the order of their texts' digests; equal rows are one."""
    order = sorted({(NONE if i is None else i, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for i, t in rows})
    first, out = {}, {}
    for n, (_, _, t) in enumerate(order):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), (n, k))
    for n, (i, _, t) in enumerate(order):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = {p for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < (n, k) for p in range(k, k + size)}
        out[i, t] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return sorted(((None if i is None else i, *out[NONE if i is None else i, t or ""]) for i, t in rows), key=str)


def test_substring_of_repeated_ids(spark):
    rng = random.Random(6)
    p, q = words(rng, 45), words(rng, 30)
    rows = [(1, "a b c"), (1, "x " * 30 + p), (2, p), (3, None), (3, p), (3, p), (None, q), (None, "y " + q), (4, q + " " + p + " " + q)]
    rows += [(9, " ".join(thue_morse(64))), (10, " ".join(thue_morse(64, "e", "a")))]
    found = substring.remove_repeats(frame(spark, rows).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=str) == brute_repeats(rows, 20)


def test_very_long_texts(spark):
    rng = random.Random(7)
    base = words(rng, 1000)
    rows = [(1, (base + " ") * 1500), (2, "x" * 9_000_000), (3, base)]
    assert len(rows[0][1]) > 4_000_000
    df = frame(spark, rows)
    out = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(df, with_text=False).collect()}
    assert out == {1: (1_500_000, 1_499_000), 2: (1, 0), 3: (1000, 1000)}
    ids, counts = tokens.Encoder(WORD_BPE).encode([t.encode() for _, t in rows[::2]])
    assert counts[0] == 1500 * counts[1] and (ids[: counts[1]] == ids[-counts[1] :]).all()
    model = pseudo.fit(df)
    assert {r.doc_id: r.n_words for r in pseudo.score(df, model).collect()} == {1: 1_500_000, 2: 1, 3: 1000}
    plain = toxicity.train([b"good day", b"bad day"] * 20, np.array([0, 1] * 20), epochs=1)
    assert all(0 <= s <= 1 for s in plain.scores([t.encode() for _, t in rows]))


def test_counter_forgets_long_segments():
    counts = edits.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    long = "x" * 100_000
    first = counts.counts([long, " a"])
    counts.learn([[" b"]])
    assert long not in counts.known and " a" in counts.known
    assert counts.counts([long, " a"]) == first


def shingles(text):
    w = [x for x in re.split(r"[ \t-\r]+", (text or "").lower()) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_fingerprints_of_kept_hashes(spark, odd):
    """With a quarter kept: what all hashes give when those above the threshold are left out."""
    every = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in fingerprint.edited_fingerprints(odd, scale=1).collect()}
    found = fingerprint.edited_fingerprints(odd.repartition(3)).collect()
    rows = sorted(((NONE if i is None else i, t or "") for i, t in odd_rows()))
    after = {t: rows[(k + 1) % len(rows)][1] for k, (_, t) in enumerate(rows)}
    low = lambda x: {h for h in re.findall("[0-9a-f]{16}", x) if 0x8000000000000000 <= int(h, 16) < 0xC000000000000000}  # noqa: E731  the lowest quarter of signed numbers
    texts = dict(odd_rows())
    for r in found:
        full = every[r.doc_id, r.n_chars, r.edited_sha256]
        a, b = low(full.fingerprint), low(full.edited_fingerprint)
        if a:
            assert set(re.findall("[0-9a-f]{16}", r.fingerprint)) == a
        else:
            assert r.fingerprint == "" if r.n_chars == 0 or full.fingerprint == "" else re.fullmatch("~[0-9a-f]{16}", r.fingerprint)
        want = len(a & b) / len(a | b) if a | b else float(full.fingerprint == full.edited_fingerprint)
        assert abs(r.near_edited - want) < 1e-12
        inside = len(a & b) / len(a) if a else float(full.fingerprint in ("", full.edited_fingerprint))
        assert abs(r.in_edited - inside) < 1e-12
        if r.doc_id is not None and r.doc_id != 120:
            x, y = shingles(texts[r.doc_id]), shingles(after[texts[r.doc_id] or ""])
            if r.doc_id not in (0, 100, 101, 110, 111, 115):  # equal texts have several successors
                assert abs(full.near_next - (len(x & y) / len(x | y) if x | y else 1)) < 1e-9


def test_short_texts_have_fingerprints_of_their_own(spark):
    rows = [(k, f"word{k} two three") for k in range(40)] + [(50, "word1 two three")]
    found = {r.doc_id: r for r in fingerprint.edited_fingerprints(frame(spark, rows)).collect()}
    assert len({r.fingerprint for r in found.values()}) == 40 and found[1].fingerprint == found[50].fingerprint
    assert all(r.near_next == 0 for k, r in found.items() if k < 39)


UNITS = set(decontaminate.UNITS.split("|"))


def template_words(text):
    """(template word, slot value or None) of a text, by a scan of its characters."""
    out, t, k = [], text, 0
    low = lambda s: "".join(c.lower() if c.isascii() or 0xC0 <= ord(c) < 0xDF else c for c in s if not (c.isascii() and 33 <= ord(c) < 127 and not c.isalnum()))
    for m in re.finditer(r"[^ \t-\r]+", t):
        w, at = m[0], m.start()
        name = re.match(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+", w)
        if name and at >= 2 and t[at - 1] == " " and re.match(r"[a-zß-öø-ÿ0-9,;)]", t[at - 2]):
            out.append((decontaminate.NAME, low(w)))
            continue
        if number := re.match(r"([0-9]+(?:[.,:/][0-9]+)*)(.*)$", w):
            unit = re.match(r"[A-Za-z]+", number[2])
            if unit and unit[0].lower() in UNITS:
                out += [(decontaminate.NUMBER, low(number[1])), (decontaminate.UNIT, low(number[2]))]
            else:
                out.append((decontaminate.NUMBER, low(w)))
            continue
        if out and out[-1][0] == decontaminate.NUMBER and t[at - 1] == " " and re.search(r"[0-9]$", t[: at - 1]) and (u := re.match(r"[A-Za-z]+", w)) and u[0].lower() in UNITS:
            out.append((decontaminate.UNIT, low(w)))
        elif low(w):
            out.append((low(w), None))
    return out


def brute_contaminated(docs, items, window=8):
    out = {}
    for item, text in items:
        w = template_words(text or "")
        n = window if len(w) >= window else len(w)
        if item is None or n < decontaminate.SHORTEST:
            continue
        own = {k: w[k : k + n] for k in range(len(w) - n + 1)}
        plain = {k for k, x in own.items() if 2 * sum(v is not None for _, v in x) <= n}
        own = {k: own[k] for k in (plain or own)}
        for doc, body in docs:
            if doc is None:
                continue
            lines, d = {}, template_words(body or "")
            for k, x in own.items():
                for p in range(len(d) - n + 1):
                    y = d[p : p + n]
                    if [a for a, _ in x] == [a for a, _ in y] and (plain or x == y):
                        at, slots = lines.setdefault(p - k, (set(), set()))
                        at.add(k)
                        slots |= {(a, b) for (_, a), (_, b) in zip(x, y, strict=True) if a is not None}
            good = [(at, s) for at, s in lines.values() if len({a for a, _ in s}) == len(s)]
            matched, slots = set().union(*(a for a, _ in good)), set().union(*(s for _, s in good))
            if own and len(matched) >= 0.5 * len(own):
                out[doc, item] = (len(matched), len(own), len(slots), sum(a != b for a, b in slots))
    return out


def test_decontamination_brute(spark):
    rng = random.Random(15)
    names, units = ["Anna", "Boris", "Clara", "Emil"], ["kg", "km", "days"]

    def sentence(n):
        w = [rng.choice("the a of red ball takes gives then more some left box tree house near under with from".split()) for _ in range(n)]
        for k in range(2, n, rng.randrange(3, 7)):
            w[k] = rng.choice([str(rng.randrange(2, 99)), f"{rng.randrange(2, 99)} {rng.choice(units)}", f"{rng.randrange(2, 99)}{rng.choice(units)}", rng.choice(names), "3.5"])
        return " ".join(w)

    items = [(k, sentence(rng.randrange(9, 24))) for k in range(14)] + [(20, "what is 2 plus 2"), (21, "2 3 5 7 11 13 17 19 23"), (22, "too short"), (23, None), (24, "four plain words here")]
    change = lambda t: re.sub(r"[0-9]+", lambda m: str(int(m[0]) + 1), t)
    docs = []
    for k, (_, t) in enumerate(items):
        docs += [(10 * k, f"{sentence(6)} {t or ''} {sentence(5)}"), (10 * k + 1, f"{sentence(3)} {change(t or '')} {sentence(12)}"), (10 * k + 2, sentence(40)), (10 * k + 3, " ".join((t or "").split()[: rng.randrange(4, 16)]))]
    docs += [(500, "he asked what is 3 plus 3 now"), (501, "he asked what is 3 plus 4 now"), (502, "2 3 5 7 11 13 17 19 23"), (503, "2 3 5 7 11 13 17 19 24"), (504, "2 3 5 8 12 13 18 19 24")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for most in (decontaminate.BROADCAST_BYTES, 0):
        found = {(r.doc_id, r.item_id): (r.matched, r.item_windows, r.slots, r.changed) for r in decontaminate.contaminated(frame(spark, docs), bench, broadcast_bytes=most).collect()}
        assert found == brute_contaminated(docs, items)
    assert (500, 20) in found and (501, 20) not in found and (502, 21) in found and (504, 21) not in found


def brute_log_prob(model, text, table):
    """Word by word, in double precision."""
    own = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    ids, _, _, h = model.ids([text.encode()])
    ids = ids.tolist()
    embed, w1, b1, w2, b2, weights = (p.astype(float) for p in model.params)
    total = 0.0
    for k in range(len(own)):
        p = k + pseudo.SIDE
        x = np.concatenate([embed[ids[p + j]] for j in (-2, -1, 1, 2)])
        hidden = np.tanh(x @ w1 + b1)
        z = np.exp(hidden @ w2 + b2)
        t = ids[p]
        c = model.group[t]
        members = [i for i in range(len(model.group)) if model.group[i] == c]
        s = [math.exp(hidden @ weights[model.place[i]] + model.share[i]) for i in members]
        total += math.log(z[c] / z.sum()) + math.log(s[members.index(t)] / sum(s))
        if t >= pseudo.VOCAB:
            total += math.log(table.get(int(h[k]), pseudo.UNSEEN)) - model.mass[t]
    return len(own), total


def test_pseudo_likelihood_brute(spark):
    rng = random.Random(22)
    common = [f"c{k}" for k in range(3000)]
    docs = [(k, " ".join([*(rng.choice(common[: 10 ** rng.randrange(1, 4)]) for _ in range(150)), *(f"r{rng.randrange(6000)}" for _ in range(60))])) for k in range(80)]
    model = pseudo.fit(frame(spark, docs).repartition(3))
    assert np.abs(model.params[5]).max() > 0.01
    table = {}
    for r in model.table.collect():
        table |= dict(zip(np.frombuffer(r.h, "<u8").tolist(), np.frombuffer(r.n, "<i8").tolist(), strict=True))
    rows = [*docs[:6], (900, "never seen words"), (901, ""), (902, None), (903, "c1"), (904, docs[0][1])]
    found = {r.doc_id: r for r in pseudo.score(frame(spark, rows).repartition(2), model).collect()}
    for i, t in rows:
        n, total = brute_log_prob(model, t or "", table)
        assert found[i].n_words == n and abs(found[i].log_prob - total) < 1e-3 * max(1, n)


def test_words_of_a_class_depend_on_context(spark):
    """Pairs of words of equal counts: only the context tells which one stands there."""
    rng = random.Random(23)
    text = lambda: " ".join(f"a{k} b{k} c{k}" for k in (rng.randrange(100) for _ in range(60)))
    model = pseudo.fit(frame(spark, [(k, text()) for k in range(400)]).repartition(2), rounds=12, stride=1)
    good = [(k, f"a{k} b{k} c{k}") for k in range(100)]
    bad = [(1000 + k, f"a{k} b{(k + 31) % 100} c{k}") for k in range(100)]
    found = {r.doc_id: r.log_prob for r in pseudo.score(frame(spark, good + bad), model).collect()}
    assert np.mean([found[k] for k in range(100)]) > np.mean([found[1000 + k] for k in range(100)]) + 1


def test_toxicity_brute():
    """The network's score word by word, and the best threshold by trying all."""
    rng = np.random.default_rng(3)
    pick = lambda words_, n: " ".join(rng.choice(words_, n))
    mild, foul = [f"mild{k}" for k in range(40)], [f"foul{k}" for k in range(10)]
    docs = [pick(mild, 30) + (" " + pick(foul, 3) if k % 2 else "") for k in range(400)]
    labels = np.array([k % 2 for k in range(400)])
    model = toxicity.train([d.encode() for d in docs], labels, epochs=4)
    for text in [*docs[:6], "", "Foul1", "unknown words"]:
        rows, start, language = toxicity.features([text.encode()])
        vec = model.embed[rows].sum(axis=1)
        pooled = []
        for f, bias in zip(model.filters, model.bias, strict=True):
            at = [sum(vec[p + j] @ f[j] for j in range(len(f)) if p + j < len(vec)) + bias for p in range(len(vec))]
            pooled.append(np.maximum(np.max(at, axis=0), 0))
        logit = np.concatenate(pooled) @ model.weight + model.offset
        assert abs(model.scores([text.encode()])[0] - 1 / (1 + math.exp(-(logit - model.thresholds[language[0]])))) < 1e-4
    fresh = [pick(mild, 30) + (" " + pick(foul, 3) if k % 2 else "") for k in range(200)]
    assert np.mean((model.scores([d.encode() for d in fresh]) >= 0.5) == labels[:200]) > 0.95


def test_thresholds_by_language():
    words_of = lambda lang, n, rng: " ".join(rng.choice(toxicity.FUNCTION_WORDS[lang].split(), n))
    rng = np.random.default_rng(5)
    docs, labels = [], []
    for k in range(400):
        lang = ("en", "de")[k % 2]
        docs.append(f"{words_of(lang, 20, rng)} {'vile ' * (1 if lang == 'en' else 2) if k % 4 < 2 else 'fine '}".encode())
        labels.append(int(k % 4 < 2))
    model = toxicity.train(docs, np.array(labels), epochs=4)
    assert len(set(model.thresholds[:2])) == 2 and model.thresholds[2] == model.thresholds[3] == model.thresholds[4]
    assert toxicity.features([b"der die das und", b"the and of", b"zzz"])[2].tolist() == [1, 0, -1]


def test_sample_is_bounded(spark):
    rows = [(k, f"text {k} " + "x " * 1000) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(5, 0), (5, None)], "doc_id bigint, toxic int")
    seen = []
    real, toxicity.train = toxicity.train, lambda docs, y: seen.append(docs) or real(docs, y, epochs=1)
    try:
        toxicity.fit(frame(spark, rows), labels, sample_bytes=20_000)
        toxicity.fit(frame(spark, rows), labels, per_class=4)
    finally:
        toxicity.train = real
    assert 0 < sum(map(len, seen[0])) <= 20_000 and len(seen[0]) == 9 and len(seen[1]) == 8


def test_mixing_brute(spark):
    """Raking and calibration cell by cell in plain Python."""
    rng = random.Random(31)
    rows = [(k, words(rng, rng.randrange(1, 80)) + (" | | | | | |" * 9 if k % 7 == 0 else "\n" * 30 if k % 5 == 0 else "")) for k in range(300)]
    df = frame(spark, rows)
    targets = {"source": {"s0": 0.5, "s1": 0.3, "s2": 0.2}}
    found = mixing.mixed(df, targets, budget=0.4).collect()
    cells, weight = {}, {}
    for r in found:
        c = (r.source, r.lang, r.topic)
        cells[c] = cells.get(c, 0) + r.n_tokens
    weight, total = dict.fromkeys(cells, 1.0), sum(cells.values())
    goal = []
    for k in range(3):
        sums = {}
        for c, n in cells.items():
            sums[c[k]] = sums.get(c[k], 0) + n
        raised = targets["source"] if k == 0 else {x: n**mixing.ALPHA for x, n in sums.items()}
        goal.append({x: v / sum(raised.values()) * total for x, v in raised.items()})
    for _ in range(300):
        for k in range(3):
            now = {}
            for c, n in cells.items():
                now[c[k]] = now.get(c[k], 0) + n * weight[c]
            weight = {c: w * goal[k][c[k]] / now[c[k]] for c, w in weight.items()}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(1, mid * weight[c]) for c, n in cells.items()) < 0.4 * total else (low, mid)
    assert all(abs(r.probability - min(1, low * weight[r.source, r.lang, r.topic])) < 1e-4 for r in found)


def test_warc_brute(spark):
    """Both records laid out by hand from a page's parts."""
    rng = random.Random(41)
    rows = [(k, f"http://host{k}/p", f"<html lang=en><head><title>T{k}</title></head><body><p>{words(rng, 30)}</p><a href='/x{k}'>link {k}</a></body></html>") for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    sha = lambda b: "sha1:" + __import__("base64").b32encode(hashlib.sha1(b).digest()).decode()
    for r in warc.derivatives(warc.responses(pages)).collect():
        page = rows[r.page_id][2]
        text = f"T{r.page_id}\n{re.search('<p>(.*)</p>', page)[1].strip()}\nlink {r.page_id}"
        head, _, block = bytes(r.conversion).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert block == text.encode() + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        assert fields == {
            "WARC-Type": "conversion", "WARC-Record-ID": r.conversion_id, "WARC-Refers-To": r.response_id, "WARC-Target-URI": rows[r.page_id][1], "WARC-Date": warc.DATE, "WARC-Refers-To-Target-URI": rows[r.page_id][1], "WARC-Refers-To-Date": warc.DATE,
            "WARC-Source-Payload-Digest": sha(page.encode()), "WARC-Payload-Digest": sha(text.encode()), "Content-Type": "text/plain; charset=utf-8", "WARC-Block-Digest": sha(text.encode()), "Content-Length": str(len(text.encode())),
        }
        head, _, block = bytes(r.metadata).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert fields["WARC-Type"] == "metadata" and fields["WARC-Refers-To"] == r.response_id and fields["WARC-Concurrent-To"] == r.conversion_id
        assert int(fields["Content-Length"]) == len(block) - 4 and fields["WARC-Block-Digest"] == sha(block[:-4])
        assert f"outlink: /x{r.page_id}\r\n" in block.decode() and "language: en\r\n" in block.decode() and f"title: T{r.page_id}\r\n" in block.decode()


def test_warc_damage(spark):
    good = warc.response_of("http://a", "<p>x", "k")
    negative = re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: -37\r\n\r\nHTTP", good)
    packed = gzip.compress(good)
    rows = [(1, good), (2, negative), (3, packed[:-9]), (4, packed[:12] + b"\xff\xff" + packed[14:]), (5, packed), (6, b"\x1f\x8b"), (7, good + good), (8, good.replace(b"Content-Length: ", b"Content-Length: x"))]
    found = {r.page_id: r for r in warc.derivatives(spark.createDataFrame([(i, bytearray(x)) for i, x in rows], "page_id bigint, response binary")).collect()}
    assert {i for i, r in found.items() if r.error is None} == {1, 5} and found[1].text == found[5].text == "x"


@pytest.mark.parametrize("piece", ["<!-- ", "<script>", "<a ", "<p ", "<title>", "<", "</", "<a href=\"", " \n", "<html ", "&"])
def test_unclosed_pieces_take_linear_time(piece):
    began = time.perf_counter()
    warc.derive(warc.response_of("u", piece * 200_000, "k"))
    assert time.perf_counter() - began < 10
