"""The tracking store: five Parquet tables kept as a log, their merged and latest-row views, and the evaluation cache."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The schemas.
SCHEMAS = {
    "experiments": "experiment_id long, created_at string, run_name string, mode string, config_json string, config_hash string, evaluation_hash string, eval_code_hash string, code_hash string, data_type string, dataset_id string, dataset_version string, data_fp_hash string, python string, platform string",
    "runs": "run_id long, experiment_id long, created_at string, split string, fold int, strategy_name string, strategy_json string, strategy_hash string, status string, error string, elapsed_ms long",
    "metrics": "experiment_id long, run_id long, key string, value double",
    "artifacts": "experiment_id long, run_id long, name string, content string, content_type string, compression string",
    "best_candidates": "experiment_id long, rank int, created_at string, score_key string, score_value double, strategy_hash string, strategy_name string, strategy_json string",
}
EXPERIMENT = "__experiment__"
#: What a row is found by: a later write of the same key replaces it.
KEYS = {
    "experiments": ["experiment_id"],
    "runs": ["experiment_id", "run_id"],
    "metrics": ["experiment_id", "run_id", "key"],
    "artifacts": ["experiment_id", "run_id", "name"],
    "best_candidates": ["experiment_id", "rank"],
}
#: Columns that lookups compare with one value: their Parquet files have Bloom filters, and their rows lie together.
LOOKED_UP = {"experiments": ["evaluation_hash"], "runs": ["strategy_hash", "split"], "metrics": ["key"], "artifacts": ["name"], "best_candidates": ["strategy_hash"]}
LAYOUT = "v2"
#: An experiment's run ids begin here times its id, so that no two experiments share one.
RUNS_OF_ONE = 1 << 32


class Tables(NamedTuple):
    experiments: DataFrame
    runs: DataFrame
    metrics: DataFrame
    artifacts: DataFrame
    best_candidates: DataFrame


class Store:
    """Tables below a folder that Spark can reach, as a log.

    Every write of an experiment has a number (seq) and goes to files of its own, below experiment_id and seq; nothing is
    overwritten. It counts from the moment its marker is there, a file whose creation is atomic and comes last, so
    readers see the rows of all tables of a write or none, and those of a writer that died never. Of rows with one key
    the one with the greatest seq holds (KEYS). Ids of experiments and writes are claimed by creating a file that must not
    be there yet. Opening a store of the layout before (tables without a log) copies it into this one, once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")
        self.path = f"{self.root}/{LAYOUT}"
        if not self._exists(self.path) and any(self._exists(f"{self.root}/{t}") for t in SCHEMAS):
            self._take_over()

    # files
    def _file(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        fs, where = self._file(path)
        return fs.exists(where)

    def _create(self, path: str) -> bool:
        """Creates a file of one byte; False if there is one already. Spark doesn't list it before the byte is there."""
        fs, where = self._file(path)
        try:
            out = fs.create(where, False)
            out.write(1)
            out.close()
        except Py4JJavaError as e:
            if fs.exists(where):
                return False
            raise e
        return True

    def _claim(self, folder: str) -> int:
        """The first number of a folder that nobody has, taken by creating its file."""
        taken = lambda n: self._exists(f"{self.path}/{folder}/{n}")
        low, high = 0, 1
        while taken(high):
            low, high = high, high * 2
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if taken(middle) else (low, middle)
        while not self._create(f"{self.path}/{folder}/{high}"):
            high += 1
        return high

    # the log
    def commits(self) -> DataFrame:
        """experiment_id, seq and base (whether it stands for all before) of the writes that count."""
        folder = f"{self.path}/commits"
        if not self._exists(folder):
            return self.spark.createDataFrame([], "experiment_id long, seq long, base boolean")
        name = F.split(F.element_at(F.split("path", "/"), -1), "-")
        return self.spark.read.format("binaryFile").load(folder).select(F.get(name, F.lit(0)).cast("long").alias("experiment_id"), F.get(name, F.lit(1)).cast("long").alias("seq"), (F.size(name) == 3).alias("base"))

    def log(self, name: str) -> DataFrame:
        """Every row that was written, whether it counts or not, with seq."""
        schema = SCHEMAS[name] + ", seq long"
        if not self._exists(f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def read(self, name: str, commits: DataFrame | None = None) -> DataFrame:
        """A table as it stands; empty if nothing counts yet."""
        return merged(self.log(name), self.commits() if commits is None else commits, KEYS[name]).drop("seq")

    def tables(self) -> Tables:
        commits = self.commits()
        return Tables(*[self.read(t, commits) for t in SCHEMAS])

    def next_seq(self, experiment_id: int) -> int:
        return self._claim(f"writes/{experiment_id}")

    def write(self, name: str, df: DataFrame, experiment_id: int, seq: int) -> None:
        """Adds rows of one write of an experiment; they count from commit() on."""
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        df = df.withColumn("experiment_id", F.lit(experiment_id)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        self._write(name, df.withColumn("seq", F.lit(seq)), self.path)

    def _write(self, name: str, df: DataFrame, path: str) -> None:
        writer = df.hint("rebalance").sortWithinPartitions("experiment_id", "seq", *LOOKED_UP[name]).write.mode("append")
        for c in LOOKED_UP[name]:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.partitionBy("experiment_id", "seq").parquet(f"{path}/{name}")

    def commit(self, experiment_id: int, seq: int, base: bool = False) -> None:
        self._create(f"{self.path}/commits/{experiment_id}-{seq}{'-base' if base else ''}")

    def append(self, experiment_id: int, **tables: DataFrame) -> None:
        """One write of several tables."""
        seq = self.next_seq(experiment_id)
        for name, df in tables.items():
            self.write(name, df, experiment_id, seq)
        self.commit(experiment_id, seq)

    def compact(self, experiment_id: int) -> None:
        """Writes what counts of an experiment once more as one write that stands for all before; readers skip those files."""
        commits = self.commits().where(F.col("experiment_id") == experiment_id)
        seq = self.next_seq(experiment_id)
        for name in SCHEMAS:
            self.write(name, self.read(name, commits).where(F.col("experiment_id") == experiment_id), experiment_id, seq)
        self.commit(experiment_id, seq, base=True)

    def settled(self, df: DataFrame, name: str) -> DataFrame:
        """df written below the store's work folder and read again: it is computed once, and lineage and plan end there."""
        path = f"{self.path}/work/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_settled(self, name: str) -> None:
        fs, where = self._file(f"{self.path}/work/{name}")
        fs.delete(where, True)

    # experiments and runs
    def create_experiment(self, row: dict) -> int:
        """Claims an id and stores the experiment, which counts at once."""
        number = self._claim("claims")
        fields = [f.split()[0] for f in SCHEMAS["experiments"].split(", ")]
        self.append(number, experiments=self.spark.createDataFrame([tuple(number if f == "experiment_id" else row.get(f) for f in fields)], SCHEMAS["experiments"]))
        return number

    def start_runs(self, experiment_id: int, runs: DataFrame) -> None:
        """Stores runs as running. Whoever reads the store sees them so until they finish, and for good if their writer dies."""
        self.append(experiment_id, runs=runs.withColumns({"status": F.lit("running"), "error": F.lit(None).cast("string"), "elapsed_ms": F.lit(None).cast("long")}))

    def finish_runs(self, experiment_id: int, runs: DataFrame, **others: DataFrame) -> None:
        """Stores finished runs with their metrics and artifacts; rows of the same keys are replaced."""
        self.append(experiment_id, runs=runs, **others)

    def fail_running(self, experiment_id: int, error: str) -> None:
        """Turns the runs of an experiment that are still running into errors."""
        own = self.read("runs").where((F.col("experiment_id") == experiment_id) & (F.col("status") == "running"))
        self.append(experiment_id, runs=own.withColumns({"status": F.lit("error"), "error": F.lit(error)}))

    def _take_over(self) -> None:
        """Copies tables of the layout before, with what their older rows lack, as write 1 of each experiment."""
        new = f"{self.root}/{LAYOUT}-{uuid.uuid4().hex}"
        old = {t: self.spark.read.schema(SCHEMAS[t]).parquet(f"{self.root}/{t}") if self._exists(f"{self.root}/{t}") else self.spark.createDataFrame([], SCHEMAS[t]) for t in SCHEMAS}
        old["experiments"] = migrated(old["experiments"], old["runs"], old["artifacts"])
        for name, df in old.items():
            self._write(name, df.withColumn("seq", F.lit(1).cast("long")), new)
        fs, here = self._file(new)
        there = self._file(self.path)[1]
        self.path = new
        for r in old["experiments"].select("experiment_id").toLocalIterator():
            for file in (f"claims/{r[0]}", f"writes/{r[0]}/1", f"commits/{r[0]}-1"):
                self._create(f"{new}/{file}")
        if not fs.rename(here, there) and not fs.exists(there):
            raise OSError(f"{new} can't be renamed")
        self.path = f"{self.root}/{LAYOUT}"


def merged(log: DataFrame, commits: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a log that hold: of committed writes, none before an experiment's last base, and of each key the newest.

    commits has a row for each write and prunes the log's partitions; newest rows come from an aggregate, so a key that is
    written often combines before the shuffle.
    """
    last = commits.where("base").groupBy("experiment_id").agg(F.max("seq").alias("_base"))
    valid = commits.join(last, "experiment_id", "left").where(F.col("_base").isNull() | (F.col("seq") >= F.col("_base"))).select("experiment_id", "seq")
    return latest(log.join(valid, ["experiment_id", "seq"], "left_semi"), keys, "seq")


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def migrated(experiments: DataFrame, runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """experiments with what older rows lack filled in: eval_code_hash from code_hash, dataset fields from the meta run's record
    of the data, else the config. Their evaluation_hash stays as it is: the content that it stood for isn't there to be read."""
    prints = latest_artifact(runs, artifacts, "meta", "data_fingerprint").select("experiment_id", F.col("content").alias("_print"))
    df = experiments.join(prints, "experiment_id", "left")
    fields = {"data_type": "type", "dataset_id": "dataset_id", "dataset_version": "dataset_version", "data_fp_hash": "fingerprint_hash"}  # of records before the log
    for column, name in fields.items():
        config = F.get_json_object("config_json", f"$.data.{name}")
        if column == "dataset_id":
            config = F.coalesce(config, F.element_at(F.split(F.get_json_object("config_json", "$.data.path"), "/"), -1), F.get_json_object("config_json", "$.data.type"))
        df = df.withColumn(column, F.when(blank(column), F.coalesce(F.get_json_object("_print", f"$.{name}"), config)).otherwise(F.col(column)))
    df = df.withColumn("eval_code_hash", F.when(blank("eval_code_hash"), F.col("code_hash")).otherwise(F.col("eval_code_hash")))
    return df.select(*experiments.columns)


def latest(df: DataFrame, keys: list[str], by: str = "run_id") -> DataFrame:
    """The row of each key with the greatest by: an aggregate, so hot keys combine before the shuffle, and filters of keys pass below it."""
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_row"))
    return rows.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def latest_metrics(runs: DataFrame, metrics: DataFrame, unfolded: bool = False) -> DataFrame:
    """experiment_id, strategy_hash, split, key, value of the newest ok run that has the key; unfolded: of runs without a fold only."""
    ok = runs.where(F.col("status") == "ok")
    if unfolded:
        ok = ok.where(F.col("fold").isNull())
    rows = ok.select("experiment_id", "strategy_hash", "split", "run_id").join(metrics.select("experiment_id", "run_id", "key", "value"), ["experiment_id", "run_id"])
    return latest(rows, ["experiment_id", "strategy_hash", "split", "key"]).select("experiment_id", "strategy_hash", "split", "key", "value")


def latest_artifact(runs: DataFrame, artifacts: DataFrame, split: str, name: str, strategy_hash: str | None = None) -> DataFrame:
    """experiment_id, run_id and content of the newest run of a split with the artifact, whatever its status."""
    mine = runs.where(F.col("split") == split)
    if strategy_hash is not None:
        mine = mine.where(F.col("strategy_hash") == strategy_hash)
    rows = mine.select("experiment_id", "run_id").join(artifacts.where(F.col("name") == name).select("experiment_id", "run_id", "content"), ["experiment_id", "run_id"])
    return latest(rows.select("experiment_id", "run_id", "content"), ["experiment_id"])


def run_metrics(metrics: DataFrame, run_id: int) -> DataFrame:
    return metrics.where(F.col("run_id") == run_id).select("key", "value")


def run_artifact(artifacts: DataFrame, run_id: int, name: str) -> DataFrame:
    return artifacts.where((F.col("run_id") == run_id) & (F.col("name") == name)).select("content")


def best_of(best: DataFrame, experiment_id: int) -> DataFrame:
    return best.where(F.col("experiment_id") == experiment_id).orderBy("rank")


def cached_runs(tables: Tables, evaluation_hash: str, eval_code_hash: str, exclude: int | None = None) -> DataFrame:
    """strategy_hash, split, fold, run_id and experiment_id of the newest ok run of other experiments with the same hashes."""
    same = tables.experiments.where((F.col("evaluation_hash") == evaluation_hash) & (F.col("eval_code_hash") == eval_code_hash))
    if exclude is not None:
        same = same.where(F.col("experiment_id") != exclude)
    runs = tables.runs.where((F.col("status") == "ok") & F.col("split").isin("train", "valid", "test"))
    rows = runs.join(same.select("experiment_id"), "experiment_id").select("strategy_hash", "split", "fold", "run_id", "experiment_id")
    return latest(rows, ["strategy_hash", "split", "fold"])


def split_by_cache(tasks: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks (strategy_hash, fold) whose train and valid runs are both cached, and the others."""
    both = cached.where(F.col("split").isin("train", "valid")).groupBy("strategy_hash", "fold").agg(F.count_distinct("split").alias("_n")).where("_n = 2").drop("_n")
    return tasks.join(both, ["strategy_hash", "fold"], "left_semi"), tasks.join(both, ["strategy_hash", "fold"], "left_anti")


def cache_diagnostics(experiments: DataFrame, evaluation_hash: str, eval_code_hash: str, code_hash: str, exclude: int) -> DataFrame:
    """How many other experiments share the evaluation, and with it the evaluation code or all code; one pass."""
    same = experiments.where((F.col("evaluation_hash") == evaluation_hash) & (F.col("experiment_id") != exclude))
    evaluated = F.col("eval_code_hash") == eval_code_hash
    return same.agg(
        F.count("*").alias("same_eval_experiments"),
        F.count(F.when(evaluated, 1)).alias("same_eval_evalcode_experiments"),
        F.count(F.when(F.col("code_hash") == code_hash, 1)).alias("same_eval_fullcode_experiments"),
        F.max(F.when(evaluated, F.col("experiment_id"))).alias("latest_same_eval_evalcode_experiment_id"),
    )


def numbered(df: DataFrame, order: list[str], first: int, column: str = "run_id") -> DataFrame:
    """Ids from first on, in the given order (over the runs of one experiment)."""
    return df.withColumn(column, (F.row_number().over(Window.orderBy(*order)) + (first - 1)).cast("long"))
