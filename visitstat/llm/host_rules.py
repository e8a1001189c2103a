"""Host-level quality rules: per-document rules, failure rates per host shrunk
with an empirical beta prior, and the host's verdict joined back.

DataFrame functions only; no Python runs on the executors. Every rule is
computed inside the document's row (arrays of words, lines and window hashes),
so the texts are never exploded or shuffled.

Defined results: a null or empty text has no words (all counts 0) and fails
the word-count rule. A null host is one host of its own. Repeated rows are
judged each on its own, and each counts in its host's rate. An empty table
gives an empty result. Extra columns are kept by ``keep_passing`` and ignored
by ``host_rules``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitstat.llm.common import SPACE, fresh
from visitstat.operators.attach import attach
from visitstat.session import write_table

WINDOW = 8                 # words in a repetition window (fixed by the contract)
SYMBOLS = "[#*$%&|<>]"     # symbol characters counted (fixed by the contract)


@dataclass(frozen=True)
class Rules:
    """Thresholds. The first two decide ``base_failed``; all four feed the host rate."""

    min_words: int = 20
    max_repeat_pct: int = 30        # words inside repeated windows, per 100 words
    max_symbol_pct: int = 50        # symbol characters, per 100 words
    max_dup_line_pct: int = 50      # repeated lines, per 100 lines with a word
    max_host_rate: float = 0.5      # a host is rejected above this shrunk failure rate


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words covered by windows whose hash occurs twice or more in the array.

    ``hashes`` holds one hash per window, in text order. Windows are put in
    (hash, position) order; those with an equal neighbour are repeated. Their
    sorted positions are then swept once, counting each covered word once.
    """
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(s: Column) -> Column:
        return F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))

    def sweep(positions: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(positions, start, lambda a, p: F.struct(
            (a["n"] + (p + window - F.greatest(p, a["end"]))).cast("bigint").alias("n"),
            (p + window).alias("end")), lambda a: a["n"])

    # transform over a one-element array binds the sorted array once
    positions = F.flatten(F.transform(F.array(ordered), lambda s: F.transform(twins(s), lambda x: x["i"])))
    return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0).cast("bigint")) \
        .otherwise(sweep(F.sort_array(positions)))


def with_rules(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` plus one struct column of counts and verdicts; returns its name too."""
    txt, words, codes, stats, hashes, lines = fresh(docs.columns, "txt", "words", "codes", "rules", "hashes", "lines")
    df = docs.withColumn(txt, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = df.withColumn(words, F.filter(F.split(txt, f"[{SPACE}]+"), lambda w: w != ""))
    # element access, not slice: slice copies the whole array on every call
    df = df.withColumn(codes, F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn(hashes, F.when(F.size(words) > WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(codes, i + k) for k in range(WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(lines, F.filter(F.split(txt, "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    n_words = F.size(words).cast("bigint")
    df = df.withColumn(stats, F.struct(
        n_words.alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        (F.size(F.split(txt, SYMBOLS)) - 1).cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col(hashes)).alias("n_repeat_words")))
    df = df.drop(txt, words, codes, hashes, lines)
    s = F.col(stats)
    base = (s["n_words"] < rules.min_words) | (100 * s["n_repeat_words"] > rules.max_repeat_pct * s["n_words"])
    extra = ((100 * s["n_symbols"] > rules.max_symbol_pct * s["n_words"])
             | (100 * s["n_dup_lines"] > rules.max_dup_line_pct * s["n_lines"]))
    return df.withColumn(stats, s.withField("base_failed", base).withField("any_failed", base | extra)), stats


def host_verdicts(judged: DataFrame, host: str, failed: Column, max_host_rate: float) -> DataFrame:
    """One row per host: documents, failures, the shrunk failure rate, ``host_ok``.

    The beta prior is fitted to the hosts' own rates by moments (weights =
    documents), with the binomial part of their spread taken off; when nothing
    is left the prior is as strong as allowed and every host gets the common
    rate. The fit reads one row of sums.
    """
    hosts = write_table(judged.groupBy(F.col(f"`{host}`").alias("host"))
                        .agg(F.count(F.lit(1)).alias("n"), F.sum(failed.cast("bigint")).alias("f")), "hosts")
    n, f = F.col("n").cast("double"), F.col("f").cast("double")
    m = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.count(F.lit(1)).alias("h"),
                  F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ffn")).first()
    a, b = beta_prior(m["n"] or 0.0, m["f"] or 0.0, m["h"], m["nn"] or 0.0, m["ffn"] or 0.0)
    rate = (f + F.lit(a)) / (n + F.lit(a + b))
    return hosts.withColumn("rate", rate).withColumn("host_ok", F.col("rate") <= F.lit(max_host_rate))


def beta_prior(n: float, f: float, h: int, nn: float, ffn: float) -> tuple[float, float]:
    """Moment estimate (alpha, beta) from sums over hosts: documents, failures,
    hosts, squared documents, failures squared by documents."""
    if n <= 0:
        return 1.0, 1.0
    p = f / n
    spread, inner = ffn - n * p * p, p * (1 - p)
    free = n - nn / n - (h - 1)
    rho = (spread - inner * (h - 1)) / (inner * free) if inner > 0 and free > 0 else 0.0
    rho = min(max(rho, 1e-6), 0.999)
    k = 1 / rho - 1
    return p * k, (1 - p) * k


def host_rules(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text",
               host: str = "source") -> DataFrame:
    """The rule digest of every document with its host's rate and the verdict.

    Columns: doc_id, the counts of ``with_rules``, base_failed, host_rate,
    host_ok, kept (false if base_failed, else the host's verdict).
    """
    need = list(dict.fromkeys([doc_id, text, host]))
    df, stats = with_rules(docs.select(*[F.col(f"`{c}`") for c in need]), rules, text)
    df = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{host}`").alias("host"), F.col(stats).alias("s"))
    judged = write_table(df, "rules")
    verdicts = host_verdicts(judged, "host", F.col("s.any_failed"), rules.max_host_rate)
    out = attach(judged, verdicts.select("host", "rate", "host_ok"), ["host"], "left")
    return out.select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words",
                      "s.base_failed", F.col("rate").alias("host_rate"), "host_ok",
                      (~F.col("s.base_failed") & F.col("host_ok")).alias("kept"))


def keep_passing(docs: DataFrame, rules: Rules = Rules(), text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` (all columns) whose document and host both pass.

    The judged rows are written once, texts included: the host rates are read
    from the small columns and the texts only in the final pass.
    """
    df, stats = with_rules(docs, rules, text)
    judged = write_table(df, "judged")
    s = F.col(stats)
    verdicts = host_verdicts(judged, host, s["any_failed"], rules.max_host_rate)
    key, ok = fresh(docs.columns + [stats], "host", "host_ok")
    passing = judged.filter(~s["base_failed"]).withColumn(key, F.col(f"`{host}`"))
    bad = verdicts.filter(~F.col("host_ok")).select(F.col("host").alias(key), F.lit(True).alias(ok))
    return attach(passing, bad, [key], "left").filter(F.col(ok).isNull()).select(
        *[F.col(f"`{c}`") for c in docs.columns])
