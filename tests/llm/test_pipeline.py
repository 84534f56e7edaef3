"""The pipeline's stages on a small table."""

import random

import corpus_pipeline
import pytest


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == names
        docs = docs.checkpoint()
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.3 * counts[0]  # so few labels teach little
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert out.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == counts[-1]


def test_odd_documents(spark, odd, sf_dir):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).checkpoint()
    assert docs.count() > 5
    nothing = odd.select("doc_id", "text", "lang", "source", "n_chars").where("false")
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, sf_dir).checkpoint()
    assert nothing.count() == 0


def planted():
    """documents and what each is: clean, toxic, a copy, a near copy or contaminated."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    vocabulary = [word() for _ in range(3000)]
    bad = ["scoundrel", "villain", "rotter", "blighter", "cad", "knave", "wretch", "cur"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, what = [], {}
    for k in range(260):
        docs.append((k, " ".join(text(rng.randrange(80, 140)))))
        what[k] = "clean"
    for k in range(300, 360):
        w = text(100)
        for _ in range(6):
            w[rng.randrange(len(w))] = rng.choice(bad)
        docs.append((k, " ".join(w)))
        what[k] = "toxic"
    items = [" ".join(text(14)) for _ in range(10)]
    for k in range(10):
        w = text(80)
        docs.append((400 + k, " ".join([*w[:30], items[k], *w[30:]])))
        what[400 + k] = "contaminated"
    for k in range(20):
        docs.append((500 + k, docs[k][1]))
        what[500 + k] = "copy"
        w = docs[40 + k][1].split()
        w[len(w) // 2] = "changed"
        docs.append((600 + k, " ".join(w)))
        what[600 + k] = "near copy"
    return docs, what, items


def test_every_stage_drops_what_is_planted(spark, tmp_path):
    docs, what, items = planted()
    full = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t)) for k, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).checkpoint()
    spark.createDataFrame([(k, 1, int(v == "toxic")) for k, v in what.items()], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    of = lambda ids, kind: {k for k in ids if what[k] == kind}
    before, gone = set(what), {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        full = stage(spark, full, str(tmp_path)).checkpoint()
        after = {r.doc_id for r in full.select("doc_id").collect()}
        gone[name], before = before - after, after
    toxic = of(what, "toxic")
    assert len(gone["toxicity"] & toxic) >= 0.9 * len(toxic) and len(gone["toxicity"] - toxic) <= 0.02 * len(what)
    left = set(what) - gone["toxicity"]
    pairs = [({k, 500 + k} & left) for k in range(20)] + [({40 + k, 600 + k} & left) for k in range(20)]
    assert gone["near_dedup"] == {max(p) for p in pairs if len(p) == 2}
    assert gone["decontamination"] == of(left, "contaminated")
    rest = corpus_pipeline.STAGES[3][1](spark, full, str(tmp_path)).select("doc_id", "text", "lang", "source", "n_chars").checkpoint()
    size = lambda df: sum(len(r.text.split()) for r in df.select("text").collect())
    assert size(rest) / size(full) == pytest.approx(corpus_pipeline.BUDGET, abs=0.08)
    tokens = corpus_pipeline.STAGES[4][1](spark, rest, str(tmp_path)).collect()
    assert {r.doc_id for r in tokens} == {r.doc_id for r in rest.collect()}
    at = 0
    for r in sorted(tokens):
        assert r.start == at
        at += r.n_tokens
