"""The pipeline's stages, each on its own input, against plain versions; awkward rows; removal of the subpackage."""

import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from parley.llm import langid, pii

from ..conftest import SF001
from . import plain


@pytest.fixture(scope="module")
def steps(spark):
    """Rows of the documents and after each stage."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    made = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001)
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema)
        made.append(rows)
    return made


def test_language_stage_drops_the_rejected(spark, steps):
    sizer = langid.Sizer(langid.learn(spark.read.parquet(f"{SF001}/documents.parquet")))
    assert sorted(map(tuple, steps[1])) == sorted(tuple(r) for r in steps[0] if not sizer.predict(r["text"])[2])
    assert len(steps[1]) > 0.97 * len(steps[0])


def test_near_duplicate_stage_keeps_the_first_of_each_group(steps):
    prints = {r["doc_id"]: plain.simhash(r["text"]) for r in steps[1]}
    roots, first = plain.groups(prints.values()), {}
    for i in sorted(prints):
        first.setdefault(roots[prints[i]], i)
    assert sorted(r["doc_id"] for r in steps[2]) == sorted(first.values())
    assert set(map(tuple, steps[2])) <= set(map(tuple, steps[1]))


def test_decontamination_stage(spark, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    hit = plain.contaminated([(r["doc_id"], r["text"]) for r in steps[2]], items)
    assert sorted(map(tuple, steps[3])) == sorted(tuple(r) for r, x in zip(steps[2], hit) if not x[-1])


def test_pii_stage(spark, steps):
    before, after = {r["doc_id"]: r for r in steps[3]}, {r["doc_id"]: r for r in steps[4]}
    assert set(before) == set(after)
    spans = {r["doc_id"]: r["pii_spans"] for r in pii.detect(spark.createDataFrame(steps[3], "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    for i, r in after.items():
        text, at, out = before[i]["text"], 0, ""
        for s in spans[i]:
            if s["start"] >= at:
                out += text[at : s["start"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["end"])
        assert r["text"] == out + text[at:]
        assert not any(plain.base_spans(r["text"], plain.PII)[:2])
        assert r["n_chars"] == (len(r["text"]) if spans[i] else before[i]["n_chars"])


def test_bpe_stage_and_run(spark, steps):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    text = {r["doc_id"]: r["text"] for r in steps[4]}
    for r in steps[5]:
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert bytes(r["token_ids"]) == raw and (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), plain.sha(raw), plain.sha(text[r["doc_id"]]))
    run = corpus_pipeline.run(spark, SF001)
    assert sorted(r["ids_sha256"] for r in run.collect()) == sorted(r["ids_sha256"] for r in steps[5])


@pytest.mark.parametrize("rows", [plain.AWKWARD, []])
def test_awkward_rows_through_every_stage(spark, rows):
    docs = plain.awkward(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001)
        made = out.collect()
        assert len(made) <= len(rows), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        one = stage(spark, plain.awkward(spark, rows), SF001)  # each stage also on its own
        assert (one.columns == docs.columns) == (name != corpus_pipeline.STAGES[-1][0])
    deduped = corpus_pipeline.simhash_near_dedup(spark, plain.awkward(spark, rows), SF001).collect()
    assert len({plain.simhash(r["text"]) for r in deduped}) == len(deduped)


def test_library_works_without_the_subpackage(tmp_path):
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(os.path.join(root, "parley"), tmp_path / "parley", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert 'thread_features' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
