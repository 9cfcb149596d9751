"""The pipeline's stages, one after another, each against a plain version on its own input."""

from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline
from cases import DDL, ODD, SF
from tokenizers import Tokenizer

from siftwood.llm import mixing, near_dup
from siftwood.llm.sources import tokenizer_path


def test_stages(spark, docs, texts, labels):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "substring_dedup", "mixing", "packing"]
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before_mixing = now
        out = stage(spark, now, SF).cache()
        assert sorted(out.columns) == sorted(docs.columns) and dict(out.dtypes) == dict(docs.dtypes), name
        seen[name] = {r["doc_id"]: r["text"] for r in out.collect()}
        now = out
    base = {d: brute.base_columns(t) for d, t in texts}
    fit = {d for d, b in base.items() if b["n_words"] >= 50 and 100 * b["n_repeat_words"] <= 50 * b["n_words"]}
    assert set(seen["quality"]) <= fit
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()} & fit
    assert len(good & set(seen["quality"])) >= 0.99 * len(good)
    kept = brute.near_duplicates(list(seen["quality"].items()))
    assert set(seen["near_dedup"]) == {d for d, (_, c) in kept.items() if d == c}
    assert set(seen["substring_dedup"]) == set(seen["near_dedup"])
    before, after = brute.covered(list(seen["near_dedup"].items())), brute.covered(list(seen["substring_dedup"].items()))
    assert sum(map(len, after.values())) <= 0.1 * sum(map(len, before.values()))
    assert all(seen["substring_dedup"][d] == t for d, t in seen["near_dedup"].items() if d not in brute.covered(list(seen["near_dedup"].items()), 12))
    # mixing: each document as often as its source's sample says, its text as it was
    said = {r["doc_id"]: r["copies"] for r in mixing.mix(before_mixing).collect()}
    taken = Counter(r["doc_id"] for r in now.collect())
    assert taken == +Counter(said) and all(seen["mixing"][d] == seen["substring_dedup"][d] for d in taken)
    # packing: every token of every copy lies in exactly one place, and sequences hold 4096 at most
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    encode = Tokenizer.from_file(tokenizer_path()).encode
    length = {d: len(encode(t or "", add_special_tokens=False).ids) + 1 for d, t in seen["mixing"].items()}
    held = Counter()
    for r in packed:
        assert r["doc_tokens"] == length[r["doc_id"]] and r["length"] > 0
        for k in (r["start"], r["start"] + r["length"]):
            assert 0 <= k <= r["doc_tokens"]
        held[r["doc_id"]] += r["length"]
    assert held == Counter({d: length[d] * n for d, n in taken.items()})
    places: dict = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for at in places.values():
        at.sort()
        assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False)) and sum(n for _, n in at) <= 4096


def test_run_is_repeatable(spark):
    a, b = (sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert a == b and a


def test_odd_rows(spark, odd):
    now, kept = odd, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        kept[name] = now.count()
    # all of these rows are short, or repeat themselves: the rules reject them
    expect = sum(b["n_words"] >= 50 and 100 * b["n_repeat_words"] <= 50 * b["n_words"] for b in (brute.base_columns(r[1]) for r in ODD))
    assert kept["quality"] <= expect and kept["near_dedup"] <= kept["quality"] and kept["substring_dedup"] == kept["near_dedup"]


def test_empty(spark):
    now = spark.createDataFrame([], DDL)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0 and len(ODD) > 0 and near_dup.K == 64
