"""JSON outputs.  Spark's committer publishes a folder whole or not at all."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

# The public fields of a question, in order.
QUESTION_FIELDS = ("number", "question", "answer1", "answer2", "answer3", "answer4", "correct_answer", "category")


def write_json(df: DataFrame, path: str, force: bool = False) -> None:
    """An existing target is an error unless ``force`` is given."""
    df.write.mode("overwrite" if force else "errorifexists").json(path)


def write_question_set(questions: DataFrame, path: str, force: bool = False) -> None:
    """Public fields only."""
    write_json(questions.select(*QUESTION_FIELDS), path, force)


def write_report(report: DataFrame, config: dict[str, str], folder: str, generated_at: datetime | None = None, force: bool = False) -> None:
    """An evaluation report (run_id, section, key, measure, value) with the run's metadata beside it.

    ``report`` is parquet by run and section; ``run`` has the configuration and the time of each run.  Without ``force`` neither may exist.
    """
    if not force and any(_exists(report, f"{folder}/{part}") for part in ("report", "run")):
        raise FileExistsError(f"{folder}: a report already exists")
    made = generated_at or datetime.now(timezone.utc)
    settings = F.create_map(*[F.lit(x) for pair in sorted(config.items()) for x in pair]) if config else F.create_map().cast("map<string,string>")
    run = report.select("run_id").distinct().select("run_id", F.lit(made.isoformat()).alias("generated_at"), settings.alias("config"))
    report.write.mode("overwrite" if force else "errorifexists").partitionBy("run_id", "section").parquet(f"{folder}/report")
    write_json(run, f"{folder}/run", force)


def write_bundle(questions: DataFrame, audit: DataFrame, folder: str, force: bool = False) -> None:
    """The audit is always written, the question set only if there are questions.

    Both targets are looked at before anything is written; with ``force`` an old question set never stays beside a new audit.
    """
    stale = _exists(questions, f"{folder}/questions")
    if not force and (stale or _exists(questions, f"{folder}/audit")):
        raise FileExistsError(f"{folder}: an audit or a question set already exists")
    some = not questions.isEmpty()
    write_json(audit, f"{folder}/audit", force)
    if some or stale:
        write_question_set(questions, f"{folder}/questions", force)


def _exists(df: DataFrame, path: str) -> bool:
    context = df.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()).exists(target)
