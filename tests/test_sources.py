import json

import pytest
from pyspark.sql import functions as F

from surecal.schemas import ARC_QUESTIONS
from surecal.sources.records import (
    read_arc_outputs,
    read_gsm8k_outputs,
    unify_outputs,
    write_outputs,
)
from surecal.sources.runs import (
    read_benchmark,
    read_manifest,
    read_predictions,
    read_run_metadata,
    run_id,
    select_runs,
    read_run_table,
    write_run_table,
)


@pytest.fixture
def legacy(tmp_path):
    """A manifest and one CSV per run, with columns in different places."""
    base = tmp_path / "runs legacy"
    (base / "sub").mkdir(parents=True)
    files = {
        "a.csv": 'question,gpt_eval,confidence\n"multi\nline, ""quoted""",1,0.9\nq,0,\n',
        "sub/b+1.csv": "confidence,gpt_eval\n0.25,0\nNaN,1\n",
        "c.csv": "question,gpt_eval,confidence\nq,True,0.5\n",
    }
    for name, text in files.items():
        (base / name).write_text(text)
    entries = [
        {"csv_file": n, "prompt": "p", "dataset": "HotpotQA" if n != "c.csv" else "GSM", "model": m}
        for n, m in zip(files, ["gpt-4o", "gpt-4o-mini", "gpt-4o"])
    ]
    (base / "data.json").write_text(json.dumps(entries))
    return base


def test_manifest_and_predictions(spark, legacy):
    manifest = read_manifest(spark, f"{legacy}/data.json")
    assert manifest.count() == 3
    rows = read_predictions(spark, manifest, str(legacy), same_header=False)
    got = sorted((r["csv_file"], r["y_true"], r["y_prob"]) for r in rows.na.fill(-1.0).collect())
    assert got == [
        ("a.csv", 0.0, -1.0), ("a.csv", 1.0, 0.9), ("c.csv", 1.0, 0.5),
        ("sub/b+1.csv", 0.0, 0.25), ("sub/b+1.csv", 1.0, -1.0),
    ]


def test_paths_spelled_differently(spark, tmp_path):
    """Dot parts, doubled slashes and a run whose own name looks like a part file."""
    (tmp_path / "sub").mkdir()
    for name, p in [("a.csv", 0.1), ("sub/a.csv", 0.2), ("sub/part-x.csv", 0.3)]:
        (tmp_path / name).write_text(f"gpt_eval,confidence\n1,{p}\n")
    names = ["./a.csv", "sub//a.csv", "sub/part-x.csv"]
    (tmp_path / "data.json").write_text(json.dumps([{"csv_file": n, "model": n, "seed": 3} for n in names]))
    manifest = read_manifest(spark, f"{tmp_path}/data.json")
    assert manifest.columns == ["csv_file", "prompt", "dataset", "model", "seed"]
    for same in (True, False):
        rows = read_predictions(spark, manifest, f"{tmp_path}/", same_header=same).collect()
        assert {r.model: r.y_prob for r in rows} == dict(zip(names, [0.1, 0.2, 0.3]))
        assert {r.seed for r in rows} == {3}


def test_a_file_without_a_run_is_an_error(spark, tmp_path):
    (tmp_path / "run=1").mkdir()
    (tmp_path / "run=1" / "x.csv").write_text("gpt_eval,confidence\n1,0.5\n")
    manifest = spark.createDataFrame([("run=1", "m")], "csv_file string, model string")
    with pytest.raises(Exception, match="no run in the manifest"):
        read_predictions(spark, manifest, str(tmp_path)).collect()


def test_damaged_json_is_an_error(spark, tmp_path):
    (tmp_path / "data.json").write_text('[{"csv_file": "a.csv"')
    with pytest.raises(Exception):
        read_manifest(spark, f"{tmp_path}/data.json").collect()
    (tmp_path / "run_1").mkdir()
    (tmp_path / "run_1" / "metadata.json").write_text('{"model": "m", "batch_size": ')
    with pytest.raises(Exception):
        read_run_metadata(spark, str(tmp_path)).collect()


def test_only_selected_files_are_opened(spark, legacy):
    chosen = select_runs(read_manifest(spark, f"{legacy}/data.json"), dataset="HotpotQA", model="gpt-4o")
    rows = read_predictions(spark, chosen, str(legacy))
    assert {r["csv_file"] for r in rows.collect()} == {"a.csv"}
    assert len(rows.inputFiles()) <= 2 and not any("b+1" in f for f in rows.inputFiles())


def test_different_headers_are_not_mixed_up(spark, legacy):
    manifest = read_manifest(spark, f"{legacy}/data.json")
    with pytest.raises(Exception):
        read_predictions(spark, manifest, str(legacy)).collect()


def test_concatenated_records(spark, tmp_path):
    run = tmp_path / "run_20250101_000000"
    run.mkdir()
    (run / "outputs.jsonl").write_text(
        '{"index": 0, "content": "a}{\\"index\\": 5", "verb_conf": 0.5}'
        '{"index": 1, "content": "b", "logprobs": [-0.5, NaN], "verb_conf": NaN}\n'
        '{"index": 2, "content": "c", "verb_conf": null}\n\n'
    )
    rows = read_gsm8k_outputs(spark, f"{tmp_path}/*/outputs.jsonl").orderBy("index").collect()
    assert [(r["index"], r["content"], r["verb_conf"]) for r in rows] == [
        (0, 'a}{"index": 5', 0.5), (1, "b", None), (2, "c", None),
    ]
    assert {r["run_id"] for r in rows} == {"run_20250101_000000"}


def test_damaged_record_is_an_error(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "outputs.jsonl").write_text('{"index": 0, "content": "a"}{"index": 1, "content": \n')
    with pytest.raises(Exception):
        read_gsm8k_outputs(spark, f"{tmp_path}/r/outputs.jsonl").collect()


def test_write_and_read_back(spark, tmp_path):
    arc = spark.createDataFrame(
        [("r1", "q1", "Q", "A", ["A", "B"], "text", None, None, [0.1, 0.9], 0.5)],
        "run_id string, id string, question string, answer string, labels array<string>, content string, "
        "thinking string, prediction string, label_probs array<double>, verb_conf double",
    )
    path = f"{tmp_path}/arc"
    write_outputs(arc, path)
    text = spark.read.text(path).first()[0]
    assert '"thinking":null' in text
    back = read_arc_outputs(spark, f"{path}/*/part-*")
    assert back.select(arc.columns).collect() == arc.collect()
    with pytest.raises(FileExistsError):
        write_outputs(arc, path)
    # Another run is added; a batch with one that is there is refused as a whole.
    second = arc.withColumn("run_id", F.lit("r2"))
    third = arc.withColumn("run_id", F.lit("r3"))
    assert write_outputs(second, path) == ["run_id=r2"]
    with pytest.raises(FileExistsError):
        write_outputs(second.unionByName(third), path)
    with pytest.raises(Exception):
        write_outputs(third.unionByName(third.withColumn("run_id", F.lit(None).cast("string"))), path)
    again = read_arc_outputs(spark, f"{path}/*/part-*")
    assert sorted(r["run_id"] for r in again.collect()) == ["r1", "r2"]
    assert sorted(p.name for p in (tmp_path / "arc").iterdir()) == ["run_id=r1", "run_id=r2"]
    write_outputs(arc, f"{tmp_path}/arc-parquet", "parquet")
    gsm = spark.createDataFrame([("r2", 7, "Q")], "run_id string, index bigint, question string")
    both = {r["item_id"]: r["run_id"] for r in unify_outputs(gsm, back).collect()}
    assert both == {"7": "r2", "q1": "r1"}


def test_metadata(spark, tmp_path):
    for name, thinking in (("run_a", True), ("run_b", False)):
        (tmp_path / name).mkdir()
        meta = {"model": "m", "batch_size": 4, "thinking": thinking, "max_samples": None, "system_prompt": "a\nb"}
        (tmp_path / name / "metadata.json").write_text(json.dumps(meta, indent=2))
    runs = read_run_metadata(spark, str(tmp_path))
    assert {(r["run_id"], r["thinking"], r["dataset"]) for r in runs.collect()} == {
        ("run_a", True, None), ("run_b", False, None),
    }
    write_run_table(runs, f"{tmp_path}/table")
    with pytest.raises(FileExistsError):
        write_run_table(runs, f"{tmp_path}/table")
    write_run_table(runs.where("thinking").withColumn("run_id", F.lit("20250101")), f"{tmp_path}/table")
    stored = read_run_table(spark, f"{tmp_path}/table")
    assert stored.columns == runs.columns
    assert {(r["run_id"], r["thinking"]) for r in stored.collect()} == {
        ("run_a", True), ("run_b", False), ("20250101", True),
    }


def test_run_id(spark):
    df = spark.sql("select timestamp'2025-03-04 05:06:07' as ts")
    assert df.select(run_id("ts")).first()[0] == "run_20250304_050607"


def test_benchmark(spark, tmp_path):
    choices = "named_struct('text', array('x'), 'label', array('A')) as choices"
    df = spark.sql(
        f"select 'q' as id, 'Q' as question, {choices}, 'A' as answerKey, c as config, s as split "
        "from values ('ARC-Easy', 'test'), ('ARC-Easy', 'train'), ('ARC-Challenge', 'test') t(c, s)"
    )
    df.write.partitionBy("config", "split").parquet(f"{tmp_path}/arc")
    got = read_benchmark(spark, f"{tmp_path}/arc", ARC_QUESTIONS, "ARC-Challenge")
    assert [(r["config"], r["split"], r["choices"]["text"]) for r in got.collect()] == [
        ("ARC-Challenge", "test", ["x"])
    ]
    assert "PartitionFilters: [isnotnull(config" in got._jdf.queryExecution().executedPlan().toString()
    assert got.select(F.count("*")).first()[0] == 1
