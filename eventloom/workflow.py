"""Pipelines: steps that call operators on each other's results, with memoised outputs and provenance.

A step's result is a DataFrame, so a pipeline runs lazily and as one plan. A result that is asked to be
kept is written under a key made of the operator, its parameters and the keys of its inputs: the same
step on the same inputs is read back instead of being computed again, in this session or a later one.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from eventloom.registry import OPERATORS, register_all


def content_key(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


@dataclass
class Step:
    operator: str
    inputs: dict[str, str]
    parameters: dict
    output: str
    keep: bool


@dataclass
class Pipeline:
    spark: SparkSession
    cache: str | None = None  # a folder for kept results
    sources: dict[str, tuple[str, DataFrame]] = field(default_factory=dict)
    steps: list[Step] = field(default_factory=list)

    def source(self, name: str, df: DataFrame, version: str = "") -> str:
        """An input table; ``version`` tells its contents apart from others of the name."""
        self.sources[name] = (content_key("source", name, version), df)
        return name

    def add(self, operator: str, inputs: dict[str, str], parameters: dict | None = None, output: str | None = None, keep: bool = False) -> str:
        step = Step(operator, dict(inputs), dict(parameters or {}), output or f"{operator}-{len(self.steps)}", keep)
        self.steps.append(step)
        return step.output

    def order(self) -> list[Step]:
        """Steps with inputs first. Raises on duplicate outputs, unknown inputs and cycles."""
        outputs = [s.output for s in self.steps]
        if doubled := {o for o in outputs if outputs.count(o) > 1 or o in self.sources}:
            raise ValueError(f"more than one step gives {sorted(doubled)}")
        done, out, left = set(self.sources), [], list(self.steps)
        while left:
            ready = [s for s in left if set(s.inputs.values()) <= done]
            if not ready:
                raise ValueError(f"no way to run {[s.output for s in left]}: inputs are missing or in a circle")
            out += ready
            done |= {s.output for s in ready}
            left = [s for s in left if s.output not in done]
        return out

    def keys(self) -> dict[str, str]:
        keys = {n: k for n, (k, _) in self.sources.items()}
        for s in self.order():
            keys[s.output] = content_key(s.operator, s.parameters, {n: keys[i] for n, i in s.inputs.items()})
        return keys

    def run(self, force: bool = False) -> dict[str, DataFrame]:
        """The results by name. Nothing is computed for results that are neither kept nor used."""
        if not OPERATORS:
            register_all()
        keys, results = self.keys(), {n: df for n, (_, df) in self.sources.items()}
        for s in self.order():
            operator = OPERATORS[s.operator]
            operator.check(s.inputs, s.parameters)
            path = f"{self.cache}/{keys[s.output]}" if self.cache and s.keep else None
            if path and not force and self._there(path):
                results[s.output] = self.spark.read.parquet(path)
                continue
            out = operator({n: results[i] for n, i in s.inputs.items()}, s.parameters)
            if path:
                out.write.mode("overwrite").parquet(path)
                out = self.spark.read.parquet(path)
            results[s.output] = out
        return results

    def _there(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def provenance(self) -> DataFrame:
        """output, key, operator, parameters, input_name, input, input_key: one row per input of each step."""
        keys = self.keys()
        rows = [(s.output, keys[s.output], s.operator, json.dumps(s.parameters, sort_keys=True, default=str), n, i, keys[i]) for s in self.order() for n, i in sorted(s.inputs.items())]
        return self.spark.createDataFrame(rows, "output string, key string, operator string, parameters string, input_name string, input string, input_key string")


def locate(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Files that are the wanted ones by content: equal size, checksum and checksum of the first 1000 bytes."""
    return wanted.join(files, ["original_size", "original_checksum", "original_checksum_1000"])


def batch(pipelines: DataFrame, datasets: DataFrame) -> DataFrame:
    """Every pipeline with every data set: both lists are a user's, one row a name."""
    return pipelines.crossJoin(datasets)


def sort_pipeline(spark: SparkSession, series: DataFrame, adjacency: DataFrame, samplerate: float, freq_min: float = 300.0, freq_max: float = 6000.0, clip_size: int = 40, interval: int = 10, threshold: float = 4.0, whiten: bool = True, noise_level: float = 0.0, cache: str | None = None) -> Pipeline:
    """The standard chain: filter, whiten (or normalize), detect, cluster per channel, merge across channels,
    fit; then metrics of the clusters and of pairs of them. Results: firings, cluster_metrics,
    cluster_pair_metrics.

    ``noise_level`` above 0 is the noise variant (0.3 in the reference): events are detected in the series
    with noise added, normalized again, and all later steps see the series without it. What several steps
    read is kept in ``cache``, where one is given."""
    p = Pipeline(spark, cache)
    p.source("raw", series)
    p.source("adjacency", adjacency)
    filtered = p.add("bandpass_filter", {"series": "raw"}, {"samplerate": samplerate, "freq_min": freq_min, "freq_max": freq_max}, "filtered")
    pre = p.add("whiten" if whiten else "normalize_channels", {"series": filtered}, {}, "pre", keep=True)
    heard = pre
    if noise_level:
        noisy = p.add("add_noise", {"series": pre}, {"noise_level": noise_level}, "noisy")
        heard = p.add("normalize_channels", {"series": noisy}, {}, "heard")
    found = p.add("detect", {"series": heard}, {"clip_size": clip_size, "interval": interval, "threshold": threshold}, "detections", keep=True)
    clustered = p.add("branch_cluster", {"series": pre, "detections": found, "adjacency": "adjacency"}, {"clip_size": clip_size, "detect_interval": interval}, "clustered", keep=True)
    events = p.add("detected_firings", {"detections": clustered}, {}, "events")
    merged = p.add("merge_across_channels_v2", {"series": pre, "firings": events}, {"clip_size": clip_size}, "merged", keep=True)
    fitted = p.add("fit_stage", {"series": pre, "firings": merged}, {"clip_size": clip_size}, "firings", keep=True)
    p.add("cluster_metrics", {"series": pre, "firings": fitted}, {"clip_size": clip_size}, "cluster_metrics")
    p.add("pair_overlap", {"series": pre, "firings": fitted}, {"clip_size": clip_size}, "cluster_pair_metrics")
    return p
