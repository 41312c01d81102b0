"""The pipeline's rows against a plain version, stage by stage, each on what its predecessor kept."""

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from assaykit.llm import decontam, near_text, secrets, toxicity


def jaccard_components(texts, width=5, similarity=0.8):
    grams = {k: {tuple(w[j : j + width]) for j in range(max(len(w) - width + 1, 1))} for k, t in texts.items() for w in [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()]}
    label = {k: k for k in texts}
    for a in texts:
        for b in texts:
            if b < a and label[a] != label[b] and len(grams[a] & grams[b]) >= similarity * len(grams[a] | grams[b]):
                old, new = sorted((label[a], label[b]), reverse=True)
                label = {k: new if x == old else x for k, x in label.items()}
    return label


def test_stages_keep_the_columns_and_the_right_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    now = docs
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, data)
        got = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            severity = {r.doc_id: r.severity for r in toxicity.assess(docs, spark.read.parquet(f"{data}/labels.parquet")).collect()}
            assert got.keys() == {k for k in rows if severity[k] < toxicity.REJECT_FROM}
            clean = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").where("toxic = 0").collect()}
            assert len(clean & rows.keys() - got.keys()) <= 0.02 * len(clean & rows.keys())
        elif name == "near_duplicates":
            # by the rule for such stages: five words and a similarity of 0.8, not the two bits of op3
            assert got.keys() == set(jaccard_components({k: r.text for k, r in rows.items()}).values())
        elif name == "decontamination":
            assert got.keys() == {k for k, r in rows.items() if not any(t in (r.text or "") for t in items)}
        elif name == "secrets":
            spans = {r.doc_id: r.spans for r in secrets.annotate(now).collect()}
            assert got.keys() == rows.keys()
            for k, r in rows.items():
                at, parts = 0, []
                for s in sorted(spans[k], key=lambda s: (s.start, s.end)):
                    if s.live:
                        parts += [r.text[at : s.start], "[secret]"] * (s.start >= at)
                        at = max(at, s.end)
                want = "".join([*parts, r.text[at:]]) if parts else r.text
                assert got[k].text == want and got[k].n_chars == (len(want) if parts else r.n_chars)
            assert any(got[k].text != r.text for k, r in rows.items())
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert got.keys() == rows.keys() and all(r.round_trip for r in got.values())
            for k in list(rows)[:50]:
                assert got[k].ids == library.encode(rows[k].text or "", add_special_tokens=False).ids
        if name != "bpe":
            assert out.columns == docs.columns
        now, rows = corpus_pipeline.cut(out, "test"), got


def test_run_gives_the_last_stage(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.columns[0] == "doc_id" and out.count() > 0
    assert np.isclose(decontam.SHARE, 0.4)


def test_toxicity_model_is_the_same_again(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    a, b = toxicity.train(docs, labels), toxicity.train(docs.repartition(3), labels.repartition(2))
    assert a.index == b.index and np.allclose(a.weights, b.weights) and np.allclose(a.thresholds, b.thresholds)


def test_near_copies_by_brute_force_jaccard(spark, monkeypatch):
    monkeypatch.setattr(near_text, "BLOCK", 3)  # families of several blocks and parts
    monkeypatch.setattr(near_text, "OTHERS", 5)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for edits in (0, 0, 1, 2, 2, 3, 4, 6, 9):
            own = list(base)
            for at in rng.integers(0, 120, edits):
                own[at] = f"e{rng.integers(0, 10**6)}"
            rows.append(" ".join(own))
    rows += ["", None, "one two", "One  two", "one two three"]
    label = jaccard_components(dict(enumerate(rows))).values()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()}
    assert got == set(label)


def test_simhash_variants_alone_give_candidates(spark, monkeypatch):
    """The stage's named method has a part of its own: with no min-hash key in common, texts of near fingerprints are still linked."""
    words = [f"w{k}" for k in range(3000)]
    rows = [" ".join(words), " ".join([*words[:-1], "end"]), "other words", " ".join(f"z{k}" for k in range(3000))]
    a, b = (near_text.fingerprint(near_text.shingle_hashes(r.encode(), 5)) for r in rows[:2])
    assert int(a ^ b).bit_count() <= 2
    monkeypatch.setattr(near_text, "band_keys", lambda shingles: np.array([shingles.sum() if len(shingles) else 0], np.uint64))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()} == {0, 2, 3}
