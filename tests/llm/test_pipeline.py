import hashlib
import re

import pytest

pytest.importorskip("rollcall.llm")
import corpus_pipeline as pipeline
from test_decontam import brute as leaks
from test_order_minhash import brute as classes
from test_pii import brute as personal
from tokenizers import Tokenizer

from rollcall.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def test_each_stage_like_brute_force_on_its_own_input(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", "x", 0), (90002, "", None, "x", 0), (90003, "12 34 $$", "en", None, 8), (90004, "mail me@x.example.org or 10.1.2.3 the and of", None, "x", 40)], docs.schema)
    docs = docs.unionByName(odd)
    columns = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "bpe"]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == columns
            out = pipeline.stash(out)
        after = {r.doc_id: r for r in out.collect()}
        ids = sorted(before)
        if name == "language_id":
            assert ids and set(before) - set(after) == {90001, 90002, 90003}
        elif name == "near_duplicates":
            roots = classes([before[i].text for i in ids])
            assert sorted(after) == [i for k, i in enumerate(ids) if roots[k] == k]
        elif name == "decontamination":
            bad = {i for i, _ in leaks([(i, before[i].text) for i in ids], items)}
            assert bad and set(after) == set(before) - bad
        elif name == "personal_data":
            assert set(after) == set(before)
            for i in ids:
                found = personal(before[i].text)
                assert (after[i].text == before[i].text) if not found and "[" not in after[i].text else True
                for s in found:
                    kind, start, end = s.split(":")
                    assert before[i].text[int(start) : int(end)] not in re.sub(r"\[[A-Z]+\]", "\n", after[i].text)
                assert after[i].n_chars == len(after[i].text)
            assert after[90004].text == "mail [EMAIL] or [IP] the and of"
        else:
            lib = Tokenizer.from_file(vocabulary())
            for i in ids:
                assert after[i].ids == lib.encode(before[i].text, add_special_tokens=False).ids
                assert after[i].decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest()
        docs, before = out, after


def test_run_gives_what_the_stages_give(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stash(stage(spark, docs, SF))
    want = sorted(map(str, pipeline.STAGES[-1][1](spark, docs, SF).collect()))
    assert sorted(map(str, pipeline.run(spark, SF).collect())) == want
