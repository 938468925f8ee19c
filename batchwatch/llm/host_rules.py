"""Host-level quality rules, in DataFrame functions only.

Each text gets its counts and rule failures inside one projection. Failures are summed by host (combined before the shuffle), every
host's failure rate is shrunk towards the rate of all hosts by a beta prior whose two parameters come from the hosts themselves
(method of moments), and the verdict of a host is joined back to its documents.

Defined cases: a null or empty text has no words, so it fails the length rule. Documents without a host are judged by their own text
only. Repeated rows are counted as rows. With no hosts, or hosts that are all alike, the prior is flat (1, 1) or as strong as
``MAX_STRENGTH``. Needed columns are picked by name first, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwatch.llm.common import SPACES, words_of, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host is dropped when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Symbols and repeated lines that fail a document in the eyes of its host, in percent of characters and lines.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 10, 30
MAX_STRENGTH = 1e6
#: Hosts up to this number are sent to all executors (at most a few MB); beyond it the join shuffles.
MOST_BROADCAST_HOSTS = 20_000


def repeated_words(words: Column) -> Column:
    """Words that lie in 3-word windows found at least twice.

    Windows are numbers that carry a hash in their high bits and the place in the low ones; sorted, equal windows are
    neighbours. Neighbours are compared word by word, so a shared hash alone never counts."""
    bits = F.ceil(F.log2(F.size(words) + 1)).cast("int")

    def keys(w: Column) -> Column:
        last = F.size(w) - 2
        places = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
        mask = F.call_function("shiftleft", F.lit(-1).cast("long"), bits)
        return F.sort_array(F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(mask).bitwiseOR(i.cast("long"))))

    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def twin(a: Column, b: Column) -> Column:
        i, j = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
        same = lambda d: F.get(words, i + d) == F.get(words, j + d)
        return F.call_function("shiftright", a.bitwiseXOR(b), bits).eqNullSafe(F.lit(0).cast("long")) & same(0) & same(1) & same(2)

    def places(sorted_keys: Column) -> Column:
        near = lambda k, i: F.coalesce(twin(k, F.get(sorted_keys, i - 1)), F.lit(False)) | F.coalesce(twin(k, F.get(sorted_keys, i + 1)), F.lit(False))
        return F.sort_array(F.transform(F.filter(sorted_keys, near), lambda k: k.bitwiseAND(low)))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = lambda found: F.aggregate(
        found, start, lambda s, p: F.struct((s["n"] + p + 3 - F.greatest(s["end"], p)).alias("n"), (p + 3).alias("end")), lambda s: s["n"]
    )
    # a one-element array binds each value once, however often the lambda below uses it
    found = F.transform(F.array(keys(words)), places)
    return F.coalesce(covered(F.get(found, F.lit(0))), F.lit(0).cast("long"))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, host and the counts of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    picked = docs.select("doc_id", F.col("source").alias("host"), text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    measured = picked.withColumn("lines", lines)
    return measured.select(
        "doc_id", "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def failures(measured: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``rules_failed`` (any rule, the host's view)."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    soft = (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
    return measured.withColumn("base_failed", base).withColumn("rules_failed", base | soft)


def host_rates(judged: DataFrame) -> DataFrame:
    """host, its documents and failures; one row for each host."""
    return judged.filter("host is not null").groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("rules_failed").cast("long")).alias("host_failures")
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) from mean and variance of the hosts' rates, one row to the driver. Less variance than sampling
    alone gives means a prior as strong as allowed."""
    rate = F.col("host_failures") / F.col("host_docs")
    row = hosts.agg(
        F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"), F.avg(1.0 / F.col("host_docs")).alias("inverse"),
    ).first()
    if row["m"] is None or not 0.0 < row["m"] < 1.0:
        return 1.0, 1.0
    spread = row["m"] * (1 - row["m"])
    between = max(row["v"] - spread * row["inverse"], 0.0)
    strength = MAX_STRENGTH if between * MAX_STRENGTH <= spread else max(spread / between - 1, 1e-3)
    return row["m"] * strength, (1 - row["m"]) * strength


def host_verdicts(hosts: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    alpha, beta = beta_prior(hosts)
    rate = (F.col("host_failures") + F.lit(alpha)) / (F.col("host_docs") + F.lit(alpha + beta))
    return hosts.select("host", "host_docs", "host_failures", rate.alias("host_rate"), (rate > max_rate).alias("host_failed"))


def apply(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row for each row of ``docs``: counts, ``base_failed``, the host's totals and ``kept``."""
    judged = written(failures(counts(docs)), "host-rules")
    hosts = written(host_rates(judged), "host-rates")
    verdicts = host_verdicts(hosts, max_rate)
    if hosts.count() <= MOST_BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    joined = judged.join(verdicts, "host", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False)))
