"""The pipeline's stages against brute force, each on its own input."""

import math
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from cases import awkward_docs, classes_by_force, empty_docs
from test_decontaminate import by_force as contaminated
from test_line_dedup import by_force as deduplicated

import corpus_pipeline
from panelstats.llm import toxicity
from panelstats.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


def rejected(model, text):
    """P(grade >= 1) of 0.6 or more, from the model's weights by plain counting."""
    words = set(re.findall(r"[^\W_]+", (text or "").lower()))
    score = 0.0
    for f, w in model.weights.items():
        kind, stem = f.lstrip("23")[0], f.lstrip("23")[1:]
        n = sum(x == stem if kind == "=" else x.startswith(stem) for x in words)
        if f[0] in "23":
            n = int(n >= int(f[0]))
        score += w * math.log1p(n)
    return bool(model.thresholds) and 1 / (1 + math.exp(-(score - model.thresholds[0]))) >= 0.6


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        path = shared_dir(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        after = sorted((r.doc_id, r.text) for r in out.collect())
        if name != "source_mixing":
            assert out.columns == docs.columns
        if name == "toxicity":
            model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert after == sorted((i, t) for i, t in before if not rejected(model, t)) and len(after) >= 0.8 * len(before)
        elif name == "line_dedup":
            assert after == sorted((i, t) for i, t, left in deduplicated(before) if left)
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "minhash_near_dedup":
            root = classes_by_force(dict(before))
            assert [i for i, _ in after] == sorted(set(root.values()))
        elif name == "benchmark_decontamination":
            bad = {r[0] for r in contaminated(before, items) if r[-1]}
            assert after == sorted((i, t) for i, t in before if i not in bad)
        else:
            assert after == sorted(before)
            assert sorted(r.mix_position for r in out.collect()) == list(range(len(after)))
        docs = out
    run = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.text) for r in run.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())


def test_awkward_and_empty(spark):
    for make in (awkward_docs, empty_docs):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            assert n <= docs.count() and (name == "source_mixing" or out.columns == docs.columns), name


def test_no_local_checkpoint_or_cross_join():
    top = Path(corpus_pipeline.__file__).parent
    for f in [top / "corpus_pipeline.py", *(top / "panelstats" / "llm").glob("*.py")]:
        assert not re.search(r"localCheckpoint|crossJoin|except ImportError", f.read_text()), f


def test_tables_of_a_run_are_released(spark):
    from panelstats.llm import common
    kept = common.shared_dir(spark, "kept")
    with common.scratch(spark):
        df = common.written(spark.range(5).toDF("x"), "gone")
        (gone,) = {f.rpartition("/")[0] for f in df.inputFiles()}
        df.write.parquet(kept)
    store, path = common.filesystem(gone)
    assert store.get_file_info(path.replace("file://", "")).type.name == "NotFound"
    assert spark.read.parquet(kept).count() == 5
