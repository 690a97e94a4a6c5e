import hashlib
import re
from collections import Counter

import public_tokenizers

import corpus_pipeline
from lodestar.llm import secret_ledger, toxicity
from lodestar.llm.token_ids import library

from .test_rules import plain_targets
from .test_simhash import brute, plain_fingerprint
from .test_tokens import check_packed

SF = "/root/testdata/sf0.001"


def redacted(text):
    spans = []
    for n, rule in enumerate(secret_ledger.RULES):
        spans += [(m.start(), n, m.end(), rule.kind) for m in re.finditer(rule.pattern, text or "") if len(m.group(rule.group)) >= rule.least]
    out, at = "", 0
    for start, _, end, kind in sorted(spans):
        if start >= at:
            out += text[at:start] + f"[{kind}]"
        at = max(at, end)
    return out + text[at:] if spans else text


def taken(rows):
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    target, done, out = plain_targets(sizes), Counter(), Counter()
    for r in sorted(rows, key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest()):
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        s = r["source"]
        out[r["doc_id"]] = sum(done[s] + e * sizes[s] + size / 2 <= target[s] for e in range(3)) if size else int(done[s] <= target[s])
        done[s] += size
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF).cache()
        after = docs.collect()
        if name == "toxicity":
            frame = spark.createDataFrame(before, spark.read.parquet(f"{SF}/documents.parquet").schema)
            model = toxicity.fit(frame, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {r["doc_id"] for r in toxicity.score(frame, model).collect() if r["score"] < 0.3}
            assert {r["doc_id"] for r in after} == want
        if name == "near_duplicates":
            ordered = sorted(before, key=lambda r: r["doc_id"])
            groups = brute([plain_fingerprint(r["text"]) for r in ordered])
            assert sorted(r["doc_id"] for r in after) == [r["doc_id"] for i, r in enumerate(ordered) if groups[i] == i]
        if name == "secrets":
            assert sorted((r["doc_id"], r["text"]) for r in after) == sorted((r["doc_id"], redacted(r["text"])) for r in before)
            texts = {r["doc_id"]: r for r in before}
            assert all(r["n_chars"] == (len(r["text"]) if r["text"] != texts[r["doc_id"]]["text"] else texts[r["doc_id"]]["n_chars"]) for r in after)
        if name == "mixing":
            want = {i: n for i, n in taken(before).items() if n}
            assert Counter(r["doc_id"] for r in after) == Counter(want)
        if name == "packing":
            check_packed(after, 2048)
            tokens = library(public_tokenizers.path("byte_bpe_50k.json"))
            want = Counter()
            for r in before:
                want[r["doc_id"]] += len(tokens.encode(r["text"] or "", add_special_tokens=False).ids) + 1
            got = Counter()
            for r in after:
                got[r["doc_id"]] += r["length"]
            assert got == want
        else:
            assert docs.columns == columns
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
