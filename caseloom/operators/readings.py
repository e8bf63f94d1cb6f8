"""Typed answers of a judge as tables: parsing, gates, the option space, beams, packing of batches, triage.

A judge is any table of answers: (about, question, noul, choice, score, probabilities map<string,double>, confidence).
Without one every function leaves the engine's own results as they are. Nothing here calls a service.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import GATE

PAIR_SEP = " > "
BEAM, MAX_LABEL_WORDS, BATCH, NOISE = 3, 5, 25, 0.70


def typed(answers: DataFrame) -> DataFrame:
    """``answers`` with kind and confidence as they count; rows without a verdict go.

    A yes-or-no probability (noul) is as sure as it is far from even; a choice has its own share, else the largest; a
    score has the confidence given, if any. Numbers may be text; what is none is null.
    """
    num = lambda c: F.col(c).try_cast("double")
    share = F.coalesce(F.try_element_at("probabilities", F.col("choice")), F.array_max(F.map_values("probabilities")))
    kind = F.when(num("noul").isNotNull(), "noul").when(F.col("choice").isNotNull(), "choice").when(num("score").isNotNull(), "score")
    sure = F.when(kind == "noul", F.coalesce(num("confidence"), F.greatest(num("noul"), 1 - num("noul")))).when(kind == "choice", F.coalesce(num("confidence"), share)).otherwise(num("confidence"))
    return answers.select("*", kind.alias("kind"), sure.alias("sure")).filter("kind is not null")


def gate(pairs: DataFrame, bar: float = GATE) -> DataFrame:
    """``pairs`` (a, b, same, one_span) with pair and outcome: below the bar none is judged; no answer is no opinion and is
    let through; the same work in two spans is the same subject apart."""
    outcome = F.when(F.col("same").isNull(), "judged").when(F.col("same") < bar, "declined").when(F.coalesce(F.col("one_span") < 0.5, F.lit(False)), "same subject apart").otherwise("judged")
    return pairs.select("*", F.concat(F.least("a", "b"), F.lit("↔"), F.greatest("a", "b")).alias("pair"), outcome.alias("outcome"))


def option_space(vocabulary: DataFrame) -> DataFrame:
    """(process, step), process null for a loose step, to distinct options ``Process > Step``."""
    return vocabulary.select(F.concat_ws(PAIR_SEP, "process", "step").alias("option")).distinct()


def read_option(option: Column) -> tuple[Column, Column]:
    """(process, step) of an option; a loose step has no process."""
    at = F.instr(option, PAIR_SEP)
    process = F.when(at > 0, F.substring(option, F.lit(1), at - 1))
    return process, F.when(at > 0, F.substring(option, at + len(PAIR_SEP), F.length(option))).otherwise(option)


def steps_allowed(readings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Readings (process, step, ...) whose step the vocabulary has for their process, or has as a loose one."""
    nested = vocabulary.filter("process is not null").select("process", "step").distinct().withColumn("__n", F.lit(True))
    loose = vocabulary.filter("process is null").select("step").distinct().withColumn("__l", F.lit(True))
    both = readings.join(nested, ["process", "step"], "left").join(loose, "step", "left")
    return both.filter("coalesce(__n, __l) is not null").select(*readings.columns)


def short_labels(vocabulary: DataFrame, most: int = MAX_LABEL_WORDS) -> DataFrame:
    """Vocabulary rows whose step is a label, not a description: ``most`` words at most."""
    words = F.filter(F.split(F.trim("step"), r"\s+"), lambda w: w != "")
    return vocabulary.filter(F.size(words) <= most)


def beam(first: DataFrame, second: DataFrame, width: int = BEAM) -> DataFrame:
    """(record, process, step, confidence): the best path of two decisions.

    ``first``: (record, process, p); ``second``: (record, process, step, p). Only the ``width`` likeliest processes of a
    record are followed. A path's score is the geometric mean of its two probabilities; ties go to the likelier process,
    then by name.
    """
    order = Window.partitionBy("record").orderBy(F.desc("p"), "process")
    kept = first.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= width).select("record", "process", F.col("p").alias("__p"))
    floor = lambda c: F.greatest(F.col(c), F.lit(1e-9))
    paths = second.join(kept, ["record", "process"]).withColumn("confidence", F.sqrt(floor("p") * floor("__p")))
    best = Window.partitionBy("record").orderBy(F.desc("confidence"), F.desc("__p"), "process", "step")
    return paths.withColumn("__r", F.row_number().over(best)).filter("__r = 1").select("record", "process", "step", "confidence")


def pack(threads: DataFrame, most: int = BATCH) -> DataFrame:
    """(lane, thread, size) with batch: whole threads, in order of thread, into batches of ``most`` records; a larger thread
    is a batch of its own. Lanes are packed apart, each streamed once in order: what a batch holds depends on all before."""
    rows = threads.select("lane", "thread", F.col("size").cast("bigint").alias("size"))
    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.repartition("lane").sortWithinPartitions("lane", "thread").mapInArrow(_packed(most), f"lane {kind('lane')}, thread {kind('thread')}, size long, batch long")


def _packed(most: int):
    def run(batches):
        import pyarrow as pa

        lane, number, held = None, 0, 0
        for b in batches:
            out = []
            for of, size in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if of != lane:
                    lane, number, held = of, 0, 0
                if held and held + (size or 0) > most:
                    number, held = number + 1, 0
                held += size or 0
                out.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=["lane", "thread", "size", "batch"])

    return run


def triage(kinds: DataFrame) -> DataFrame:
    """``kinds`` (rejected, verdict, confidence, produces, ...) with rejected as it is after asking: a rule's flag stands, and
    an unflagged kind is flagged only if noise wins clearly and it does not produce anything."""
    noise = (F.col("verdict") == "machine_noise") & (F.col("confidence") >= NOISE) & ~F.coalesce(F.col("produces") >= 0.5, F.lit(False))
    return kinds.withColumn("rejected", F.col("rejected") | F.coalesce(noise, F.lit(False)))


def merged_counts(maps: DataFrame, key: list[str], col: str) -> DataFrame:
    """(key, col): the maps of counts of each key, added up."""
    each = maps.select(*key, F.explode(col).alias("__k", "__v")).groupBy(*key, "__k").agg(F.sum("__v").alias("__v"))
    return each.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "__v")))).alias(col))
