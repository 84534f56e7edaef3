"""Fingerprints, decontamination, WARC."""

import hashlib
import random

import pytest
from samples import frame, odd_rows, words

from strandwise.llm import decontaminate, fingerprint, queries, warc


def shingles(text):
    w = [x for x in text.lower().replace("\n", " ").replace("\t", " ").split(" ") if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_fingerprints(spark, odd):
    rows = sorted(((-(1 << 63) if i is None else i, t or "") for i, t in odd_rows()))
    want = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want.append((None if i == -(1 << 63) else i, len(t), hashlib.sha256(e.encode()).hexdigest()))
    found = fingerprint.edited_fingerprints(odd.repartition(3), scale=1).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=str) == sorted(want, key=str)
    prints, texts = {}, dict(odd_rows())
    for r in found:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.in_edited >= r.near_edited - 1e-9
        if r.doc_id is not None:
            prints[r.doc_id] = r.fingerprint
    assert prints[100] == prints[101] == prints[0] and prints[110] == prints[111] == ""
    assert all(len(prints[i]) == 16 * len(shingles(texts[i] or "")) for i in prints if i not in (115,))
    exact = {r.doc_id: r for r in found}
    for k, (i, t) in enumerate(rows):
        if i in (0, 7, 12, 103):
            a, b = shingles(t), shingles(rows[(k + 1) % len(rows)][1])
            assert abs(exact[i].near_next - len(a & b) / len(a | b)) < 1e-9


def test_fingerprint_edges(spark, empty):
    assert fingerprint.edited_fingerprints(empty).count() == 0
    one = fingerprint.edited_fingerprints(frame(spark, [(4, "only one document here")])).head()
    assert one.near_next == 1.0 and one.n_chars == 22


def test_sketch_is_a_fraction(spark):
    rng = random.Random(3)
    r = fingerprint.edited_fingerprints(frame(spark, [(k, words(rng, 4000)) for k in range(4)])).collect()
    assert all(0.2 < len(x.fingerprint) / 16 / 3996 < 0.3 for x in r)


ITEMS = [(1, "A train leaves Berlin at 9 and travels 120 km in 3 hours before it stops for good near Hamburg again"), (2, "Plain words without any slot stand here in a row so that windows of eight exist"), (3, "too short"), (4, None), (None, "ignored words that are long enough to have a window of their own")]


def test_decontamination(spark, empty):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rng = random.Random(5)
    rows = [(k, words(rng, 80)) for k in range(20)]
    rows[3] = (3, rows[3][1] + " " + ITEMS[1][1].upper() + " " + rows[4][1])
    rows[5] = (5, rows[5][1] + "\n" + ITEMS[0][1].replace("120", "275").replace("9", "11").replace("3 ", "5 "))
    rows[6] = (6, "x " + ITEMS[0][1])
    rows[7] = (7, " ".join(ITEMS[1][1].split()[:9]))
    rows += [(30, None), (31, ""), (None, ITEMS[1][1]), (33, ITEMS[1][1]), (33, ITEMS[1][1]), (34, "too short")]
    df = frame(spark, rows)
    for most in (decontaminate.BROADCAST_BYTES, 0):
        found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(df, bench, broadcast_bytes=most).collect()}
        assert set(found) == {(3, 2), (5, 1), (6, 1), (33, 2)}
        assert found[5, 1].changed >= 3 and found[6, 1].changed == 0
    left = decontaminate.without_contaminated(df, bench)
    assert left.columns == df.columns and left.where("doc_id in (3, 5, 6, 33)").count() == 0 and left.count() == df.count() - 5
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(df, bench.where("false")).count() == 0


def test_slots_must_agree(spark):
    bench = spark.createDataFrame([(1, "take 7 of the red balls then add 7 more of the red balls to it")], "item_id bigint, text string")
    docs = [(1, "take 8 of the red balls then add 8 more of the red balls to it"), (2, "take 8 of the red balls then add 9 more of the red balls to it")]
    found = {r.doc_id for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert 1 in found and 2 not in found


def test_warc(spark):
    page = "<html lang='de'><head><title>T &amp; U</title><script>x<y</script></head><body><p>One<br>two</p><a href=\"/l?a=1&amp;b\">l</a><!-- c --></body></html>"
    rows = [(1, "http://a/1", page), (1, "http://a/1", page), (2, None, ""), (3, "http://b\r\nX: y", None), (None, "u", "<p>é")]
    pages = spark.createDataFrame([(*r, "z", "r") for r in rows], "page_id bigint, url string, html string, response string, text string")
    records = warc.responses(pages)
    out = warc.derivatives(records).collect()
    assert len(out) == 5 and all(r.error is None for r in out)
    first = next(r for r in out if r.page_id == 1)
    assert first.text.split("\n") == ["T & U", "One", "two", "l"] and first.title == "T & U" and first.n_links == 1
    (meta, body), = warc.parse(bytes(first.metadata))
    (conv, plain), = warc.parse(bytes(first.conversion))
    head, (source, block) = dict(meta), warc.parse(bytes(records.where("page_id = 1").head().response))[0]
    assert head["WARC-Refers-To"] == dict(conv)["WARC-Refers-To"] == dict(source)["WARC-Record-ID"] == first.response_id
    assert plain.decode() == first.text and dict(conv)["WARC-Payload-Digest"] == warc.digest(plain) == first.text_digest
    assert first.payload_digest == warc.digest(page.encode()) == dict(source)["WARC-Payload-Digest"] and block.endswith(page.encode())
    fields = body.decode()
    assert "outlink: /l?a=1&b\r\n" in fields and "http-content-type: text/html; charset=utf-8" in fields and "language: de" in fields
    assert f"source-warc-payload-digest: {first.payload_digest}" in fields
    bad = warc.derivatives(spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "page_id bigint, response binary")).collect()
    assert all(r.error and r.text is None for r in bad)
    assert warc.derivatives(records.where("false")).count() == 0


def test_warc_gzip_and_damage():
    data = warc.response_of("http://a", "<p>x", "k")
    import gzip

    assert warc.parse(gzip.compress(data) + gzip.compress(data)) == warc.parse(data) * 2
    with pytest.raises(ValueError):
        warc.parse(data[:-20])


def test_warc_query_returns_both_records(spark, sf_dir):
    rows = queries.op10_warc(spark, sf_dir).limit(20).collect()
    for r in rows:
        for data, kind, own in ((r.metadata, "metadata", r.metadata_id), (r.conversion, "conversion", r.conversion_id)):
            ((headers, block),) = warc.parse(bytes(data))
            h = dict(headers)
            assert h["WARC-Type"] == kind and h["WARC-Record-ID"] == own and h["WARC-Refers-To"] == r.response_id
            assert h["WARC-Block-Digest"] == warc.digest(block) and h["WARC-Target-URI"] and h["WARC-Date"]
        assert block.decode() == r.text
    assert rows
