from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from vellum.llm import decontaminate, langid, pii
from vellum.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_only_drop_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == columns, name
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count()
        gone = [before[d] for d in before.keys() - after.keys()]
        if name == "language":
            model = tuple(langid.fit(spark.read.parquet(f"{SF}/documents.parquet")))
            rejected = {d for d, r in before.items() for lang, margin in [langid.classify(r.text, model)] if lang == "und" or margin < langid.NARROW}
            assert {r.doc_id for r in gone} == rejected
        elif name == "near_duplicates":
            sets = {}
            for d, r in before.items():
                words = r.text.lower().split()
                sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
            group = {d: d for d in before}

            def find(d, group=group):
                while group[d] != d:
                    d = group[d]
                return d

            for a in sorted(before):
                for b in sorted(before):
                    if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                        low, high = sorted((find(a), find(b)))
                        group[high] = low
            assert set(after) == {find(d) for d in before}
        elif name == "decontamination":
            index = decontaminate.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
            assert {r.doc_id for r in gone} == {d for d, r in before.items() if index.find(r.text)}
        else:
            assert not gone and all((after[d].text == r.text) == (not __import__("re").search(r"@|\d{13}|\d+\.\d+\.\d+\.\d+|\+1 \(|[0-9a-f]{40}", r.text, 2)) for d, r in before.items())
            assert all(r.n_chars == len(r.text) for r in after.values())
        before = after


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: own.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    seen = defaultdict(int)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
        seen[r.doc_id] += r.length
    assert seen == {d: len(i) for d, i in ids.items()}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
    assert docs.count() == 0 and pii.KEY
