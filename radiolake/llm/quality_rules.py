"""Quality rules for documents and the hosts they come from.

Rules are counted for each document in one pass of built-in expressions. Failures are aggregated by host, each host's
rate is shrunk towards the rate of all hosts by an empirical beta prior, and the host's verdict goes back to its
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm.common import BLANKS, documents, let, staged

#: Fewest words, and largest share in per cent of words in repeated windows.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Largest shares that a document may have before it counts against its host.
MAX_SYMBOLS, MAX_DUP_LINES, MIN_WORD_CHARS, MAX_WORD_CHARS = 0.10, 0.30, 2.0, 15.0
#: A host is rejected when its shrunk rate of failing documents is over this.
HOST_LIMIT = 0.5
#: Up to so many hosts their verdicts are broadcast (a few dozen bytes each); beyond, they are joined by a shuffle.
BROADCAST_HOSTS = 100_000
SYMBOLS = "#*$%&|<>"


def repeated_words(ws: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the array, the first occurrence included.

    Windows are compared by the 64-bit hash of their words' hashes, and lines by theirs, without a look at the words. Only texts with a repeated window pay for the sort that
    brings equal windows together; positions covered by several windows count once.
    """
    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - 2), lambda i: F.xxhash64(F.element_at(h, i), F.element_at(h, i + 1), F.element_at(h, i + 2)))

    def covered(g: Column) -> Column:
        placed = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda s, i, j: (j >= 1) & (j <= F.size(s)) & (F.element_at(s, F.greatest(F.lit(1), F.least(j, F.size(s))))["x"] == F.element_at(s, i)["x"])
        twice = let(placed, lambda s: F.array_sort(F.transform(F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: same(s, i, i - 1) | same(s, i, i + 1)), lambda i: F.element_at(s, i)["i"])))
        # each window adds its three words, less those that the window before it has covered
        return let(twice, lambda at: F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"]))

    counted = let(let(hashes, windows), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(counted).cast("long")


def document_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts, ``n_lines`` (with a word) and ``base_failed`` to the columns of ``docs``, which must not have those names.

    A null text counts as empty: no words, so it fails. Repeated rows are counted each by itself.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    letters = F.length(F.translate(value, " \t\n\x0b\x0c\r", ""))
    symbols = F.length(value) - F.length(F.translate(value, SYMBOLS, ""))
    ws = F.filter(F.split(value, f"{BLANKS}+"), lambda w: w != "")
    lines = F.transform(F.filter(F.split(value, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != ""), lambda x: F.xxhash64(x))
    counts = let(ws, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    out = docs.withColumn("__words", counts).withColumn("__lines", let(lines, lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))))
    out = out.select(
        *docs.columns,
        F.col("__words.n_words").alias("n_words"),
        letters.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        F.col("__lines.dup").cast("long").alias("n_dup_lines"),
        F.col("__lines.all").cast("long").alias("n_lines"),
        F.col("__words.n_repeat_words").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_rates(rules: DataFrame, host: str = "source") -> DataFrame:
    """Documents, failures and shrunk failure rate of each host (null is a host of its own).

    The beta prior is fitted by moments to the hosts' raw rates, each weighed by its documents: mean ``m`` and
    variance beyond the binomial one ``v`` give the strength ``m(1-m)/v - 1``, held within 1 and 1e6. Hosts with few
    documents so stay near the mean. One or no host, or equal rates: full strength.
    """
    soft = (
        F.col("base_failed")
        | (F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars"))
        | (F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"))
        | (F.col("word_chars") < MIN_WORD_CHARS * F.col("n_words"))
        | (F.col("word_chars") > MAX_WORD_CHARS * F.col("n_words"))
    )
    hosts = rules.groupBy(host).agg(F.count("*").alias("host_docs"), F.sum(soft.cast("long")).alias("host_failures"))
    k, n = F.col("host_failures"), F.col("host_docs")
    moments = hosts.agg(F.sum(k).alias("k"), F.sum(n).alias("n"), F.sum(k * k / n).alias("kk"), F.count("*").alias("hosts")).first()
    total, count = moments["n"] or 0, moments["hosts"]
    mean = (moments["k"] + 0.5) / (total + 1) if total else 0.5
    between = max(0.0, (moments["kk"] - 2 * mean * moments["k"] + mean * mean * total) / total - mean * (1 - mean) * count / total) if total else 0.0
    strength = min(1e6, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e6
    rate = (k + F.lit(mean * strength)) / (n + F.lit(strength))
    return hosts.withColumn("host_rate", rate).withColumn("host_failed", rate > HOST_LIMIT)


def judge(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: key, base counts, the host's figures, and ``kept``.

    ``kept`` is false if the document fails the base rules or its host is rejected. Null texts fail; null hosts form
    one host; extra columns are ignored; an empty table gives an empty result. The counts are written once to the
    shared folder, so texts are read once although hosts need all of them before any verdict.
    """
    rules = staged(document_rules(docs.select(F.col(key).alias("doc_id"), F.col(host).alias("__host"), F.col(text).alias("__text")), "__text").drop("__text"))
    hosts = host_rates(rules, "__host").withColumnRenamed("__host", "__of")
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    out = rules.join(hosts, F.col("__host").eqNullSafe(F.col("__of")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False))).drop("__host", "__of")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns: the pipeline's form of :func:`judge`.

    The rules are evaluated once: each row's counts are written with the row itself if it passes the base rules, and
    without it if it fails. The hosts' verdicts, from the counts of all rows, then remove rows of rejected hosts. Texts
    are never shuffled.
    """
    marked = document_rules(docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("__text"), F.col("source").alias("__host")), "__text").drop("__text")
    first = staged(marked.withColumn("__row", F.when(~F.col("base_failed"), F.col("__row"))))
    hosts = host_rates(first.drop("__row"), "__host").where("host_failed").select(F.col("__host").alias("__of"))
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    kept = first.where(~F.col("base_failed")).join(hosts, F.col("__host").eqNullSafe(F.col("__of")), "left_anti")
    return kept.select("__row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir, "doc_id", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op1_quality_rules": op1_quality_rules}

_SPLIT = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
SQL = {
    "op1_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text, {_SPLIT} AS w FROM documents),
pos AS (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
win AS (SELECT row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM pos),
rep AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS n FROM win) WHERE n >= 2),
cov AS (SELECT row_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row_id),
line AS (SELECT row_id, unnest(string_split(text, chr(10))) AS x FROM d),
dup AS (SELECT row_id, count(*) - count(DISTINCT x) AS n, count(*) AS lines FROM line WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY row_id),
base AS (SELECT d.row_id, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(dup.lines, 0) AS n_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (row_id) LEFT JOIN dup USING (row_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM base),
host AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR n_symbols > {MAX_SYMBOLS} * word_chars OR n_dup_lines > {MAX_DUP_LINES} * n_lines
  OR word_chars < {MIN_WORD_CHARS} * n_words OR word_chars > {MAX_WORD_CHARS} * n_words) AS k FROM f GROUP BY source),
mom AS (SELECT sum(k) AS k, sum(n) AS n, sum(k * k / n) AS kk, count(*) AS hosts, (sum(k) + 0.5) / (sum(n) + 1) AS m FROM host),
gap AS (SELECT m, greatest(0.0, (kk - 2 * m * k + m * m * n) / n - m * (1 - m) * hosts / n) AS v FROM mom),
prior AS (SELECT m, CASE WHEN v > 0 THEN least(1e6, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1e6 END AS s FROM gap),
verdict AS (SELECT source, (k + m * s) / (n + s) > {HOST_LIMIT} AS bad FROM host, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source"""
}
