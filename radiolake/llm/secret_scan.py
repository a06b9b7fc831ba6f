"""Secret scans in built-in expressions: fixed patterns, and a battery of randomness tests on long tokens.

A token of 20 or more characters whose alphabet is that of an encoding (hexadecimal, base 32, 36, 62 with base 58 in it, 64) is a
candidate. Three tests ask how far its characters are from random ones: chi-squared for the alphabet's uniformity, runs of
characters of one class (digits, small and capital letters, marks), and lag-1 serial correlation. A candidate's score is the
smallest of their p, times three: random tokens have it evenly between 0 and 1, ordinary ones near 0.

To call a token a secret is the discovery, so the error that counts is an ordinary token with a high score. How often that
happens is counted in the corpus: each document gives an ordinary token, some of its own words joined as identifiers and paths are, and
a fixed list of words gives some more. Scores of long tokens scatter less, so each encoding and class of lengths has its own null distribution and its own
Benjamini-Hochberg threshold; of the tokens reported there, a share of at most ``FDR`` is expected to be ordinary.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm.common import documents, let, staged

#: Fixed patterns, as Java regular expressions; the first one's second group must have 12 characters or more.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: In a run of these characters, the first match is the longest, so asking for the length in the pattern drops the same.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
_CAPITAL, _SMALL, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {"hex": _DIGIT + "abcdef", "base32": _CAPITAL + "234567", "base36": _SMALL + _DIGIT, "base62": _CAPITAL + _SMALL + _DIGIT, "base64": _CAPITAL + _SMALL + _DIGIT + "+/"}
#: Marks of base 64's other form, and what they stand for.
MARKS = ("-_", "+/")
FDR = 0.05
#: Ordinary words, of which ordinary tokens are made besides those of the corpus, and how many for each encoding and class of lengths.
WORDS = "get set user name list item value index count total order price report default config service manager factory request response handler context session account customer payment address number string object buffer stream reader writer parser builder controller component template message source target project version release system network server client".split()
HEX_WORDS = "facade decade cafe babe beef dead feed face fade bead deed added".split()
MADE = 200
#: Characters from which a document's ordinary token is taken, and the longest one.
WINDOW, LONGEST = 400, 63
#: A p-value is kept as a number of tenths of its decimal logarithm, at most this.
FINEST = 300
MASK = "[secret]"
SPAN = "array<struct<start:int,rank:int,end:int,size:int>>"


def running(steps: Column) -> Column:
    """Sums of the array up to and with each place; blocks of 64, so long arrays stay near linear."""

    def sums(s: Column) -> Column:
        part = lambda at, n: F.aggregate(F.slice(s, at, n), F.lit(0), lambda a, x: a + x)
        blocks = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / 64).cast("int")), F.array(F.lit(0)), lambda acc, j: F.concat(acc, F.array(F.element_at(acc, -1) + part(j * 64 + 1, F.lit(64)))))
        return let(blocks, lambda b: F.transform(s, lambda x, i: F.element_at(b, F.floor(i / 64).cast("int") + 1) + part(i - i % 64 + 1, i % 64 + 1)))

    return let(steps, sums)


def places(text: Column, pattern: str, rank: int, group: int = 0) -> Column:
    """Matches of a pattern in order: start, rank, end (code points, end exclusive) and length of a group.

    What lies between the matches comes from splitting by the same pattern; lengths added up give the places.
    """
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x))
    found = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    sizes = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else found
    gaps = lengths(F.split(text, pattern, -1))

    def spans(m: Column) -> Column:
        steps = let(gaps, lambda g: F.transform(m, lambda x, i: F.element_at(g, i + 1) + F.when(i > 0, F.element_at(m, F.greatest(i, F.lit(1)))).otherwise(F.lit(0))))
        return let(sizes, lambda v: let(running(steps), lambda s: F.transform(s, lambda at, i: F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + F.element_at(m, i + 1)).alias("end"), F.element_at(v, i + 1).alias("size")))))

    return F.when(text.rlike(pattern), let(found, spans)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """The fixed patterns' spans, by start, then kind as listed."""
    assigned = F.filter(places(text, ASSIGN, 0, 2), lambda s: s["size"] >= 12)
    return F.array_sort(F.concat(assigned, places(text, ACCESS, 1), places(text, HEX, 2)))


def two_sided(z: Column) -> Column:
    """Two-sided tail of the normal distribution, by the rational approximation of erfc (error under 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def encoding(token: Column) -> Column:
    """The encoding whose alphabet the token keeps to and shows enough of, the narrowest one; null if none."""
    digit, lower, upper = (token.rlike(f"[{c}]") for c in ("0-9", "a-z", "A-Z"))
    return (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$") & digit & (lower | upper), "hex")
        .when(token.rlike("^[A-Z2-7]+$") & digit & upper, "base32")
        .when(token.rlike("^([0-9a-z]+|[0-9A-Z]+)$") & digit & (lower | upper), "base36")
        .when(token.rlike("^[0-9A-Za-z]+$") & digit & lower & upper, "base62")
        .when(digit & lower & upper, "base64")
    )


def classes(alphabet: str) -> list[str]:
    """The alphabet's characters by class: digits, small and capital letters, marks."""
    return [c for c in ("".join(x for x in alphabet if x in y) for y in (_DIGIT, _SMALL, _CAPITAL, MARKS[1])) if c]


def turning(alphabet: str) -> tuple[float, float, float]:
    """For random characters: the chance that two neighbours differ in class, and the variance of the number of such
    changes among n of them as a multiple of n and a constant."""
    share = [len(c) / len(alphabet) for c in classes(alphabet)]
    change = 1 - sum(q * q for q in share)
    twice = sum(q * (1 - q) ** 2 for q in share)
    # (n - 1) changes, of which neighbours are not independent
    one, two = change * (1 - change), 2 * (twice - change * change)
    return change, one + two, -one - 2 * two


def battery(token: Column, alphabet: str) -> Column:
    """Three times the smallest p of the three tests, at most 1, for a token written in ``alphabet``."""
    k = len(alphabet)
    same = F.lower(token) if alphabet in (ALPHABETS["hex"], ALPHABETS["base36"]) else F.translate(token, *MARKS)
    kinds = classes(alphabet)
    change, slope, constant = turning(alphabet)

    def tests(c: Column) -> Column:
        codes = F.transform(F.split(c, ""), lambda ch: F.instr(F.lit(alphabet), ch) - 1)
        squares = F.aggregate(F.array(*[F.lit(ch) for ch in alphabet]), F.lit(0.0), lambda acc, ch: acc + F.pow((F.length(c) - F.length(F.replace(c, ch, F.lit("")))).cast("double"), F.lit(2.0)))
        # every class becomes one character, and a run of it another one
        marked = F.translate(c, "".join(kinds), "".join(str(i) * len(x) for i, x in enumerate(kinds)))
        turns = (F.length(F.regexp_replace(marked, "(.)\\1*", "x")) - 1).cast("double")

        def given(x: Column) -> Column:
            n = F.size(x).cast("double")
            df = float(k - 1)
            chi = F.greatest(F.lit(0.0), squares * k / n - n)
            uniform = two_sided((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
            runs = two_sided((turns - (n - 1) * change) / F.sqrt(n * slope + constant))
            mean = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v) / n

            def serial(m: Column) -> Column:
                power = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m))
                lagged = F.aggregate(F.sequence(F.lit(2), F.size(x)), F.lit(0.0), lambda acc, i: acc + (F.element_at(x, i) - m) * (F.element_at(x, i - 1) - m))
                return F.when(power > 0, two_sided((lagged / power + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0))

            return F.least(F.lit(1.0), 3 * F.least(uniform, runs, let(mean, serial)))

        return let(codes, given)

    return let(same, tests)


def scored(token: Column) -> Column:
    """A token's encoding, class of length (whole binary logarithm) and score as tenths of its logarithm; null without an encoding."""

    def by_encoding(t: Column) -> Column:
        def given(e: Column) -> Column:
            p = None
            for name, alphabet in ALPHABETS.items():
                p = F.when(e == name, battery(t, alphabet)) if p is None else p.when(e == name, battery(t, alphabet))
            # greatest() passes over nulls, but a token without an encoding is no candidate
            bin_ = let(p, lambda x: F.floor(-10 * F.log10(F.greatest(x, F.lit(10 ** (-FINEST / 10))))).cast("int"))
            return F.when(e.isNotNull(), F.struct(e.alias("encoding"), F.floor(F.log2(F.length(t))).cast("int").alias("stratum"), bin_.alias("bin")))

        return let(encoding(t), given)

    return let(token, by_encoding)


def candidates(text: Column) -> Column:
    """Candidates with their place, encoding, class of length and score."""
    spans = places(text, CANDIDATE, 3)

    def tested(s: Column) -> Column:
        score = scored(F.substring(text, s["start"] + 1, s["size"]))
        return let(score, lambda x: F.struct(s["start"].alias("start"), s["end"].alias("end"), x["encoding"].alias("encoding"), x["stratum"].alias("stratum"), x["bin"].alias("bin")))

    return F.filter(F.transform(spans, tested), lambda c: c["bin"].isNotNull())


def ordinary(text: Column) -> Column:
    """The score of an ordinary token made of a document's own words; null if it has too few.

    From a place that the text's hash chooses, words of letters are joined as in one of five ways identifiers and paths are written, up to a length
    that the hash chooses too, and end with two digits. Every document gives one, whatever its length.
    """

    def made(h: Column) -> Column:
        window = F.substring(text, (1 + F.pmod(h, F.greatest(F.lit(1), F.length(text) - WINDOW))).cast("int"), F.lit(WINDOW))
        found = F.regexp_extract_all(window, F.lit("[A-Za-z]{2,}"), F.lit(0))
        return let(found, lambda w: scored(joined(w, F.pmod(F.shiftright(h, 8), F.lit(5)), F.pmod(F.shiftright(h, 16), F.lit(LONGEST - 19)) + 18)))

    return let(F.xxhash64(text), made)


def joined(words: Column, way: Column, length: Column) -> Column:
    """Words joined in a way (0 to 4) and cut to a length, with two digits; null if they are shorter than the shortest candidate."""
    capital = F.transform(words, lambda w: F.initcap(w))
    parts = F.when(way == 0, F.array_join(capital, "")).when(way == 1, F.array_join(F.transform(words, lambda w: F.lower(w)), "")).when(way == 2, F.array_join(F.transform(words, lambda w: F.upper(w)), "")).when(way == 3, F.array_join(capital, "/")).otherwise(F.array_join(words, "_"))
    cut = F.rtrim(F.substring(parts, F.lit(1), length.cast("int")), F.lit("/_"))
    return F.when(F.length(cut) >= 18, F.concat(cut, F.lpad((F.length(cut) % 77 + 22).cast("string"), 2, "0")))


def made_tokens(spark: SparkSession) -> DataFrame:
    """``usual``: the scores of ordinary tokens from the fixed words, a bounded number for each way and class of lengths."""
    rows = spark.range(MADE * 6 * 3).select((F.col("id") % 6).cast("int").alias("way"), F.floor(F.col("id") / 6).alias("k"))
    size = F.element_at(F.array(F.lit(18), F.lit(34), F.lit(70)), (F.col("k") % 3 + 1).cast("int")) + F.pmod(F.xxhash64("k"), F.lit(12))
    pick = lambda words: F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("k", i), F.lit(len(words))) + 1).cast("int")))
    word = F.when(F.col("way") == 5, pick(HEX_WORDS)).otherwise(pick(WORDS))
    return rows.select(scored(joined(word, F.when(F.col("way") == 5, 2).otherwise(F.col("way")), size)).alias("usual"))


def thresholds(found: DataFrame) -> dict[tuple[str, int], int]:
    """For each encoding and class of lengths the bin up to which candidates are reported, over all rows' ``candidates`` and ``usual``.

    A bin's p is the share of ordinary tokens with as high a score; the reported bins are those up to the last one that passes Benjamini and
    Hochberg's test. The counts by encoding, class and bin are a few thousand rows at most, whatever the corpus.
    """
    counts = lambda df, c: df.groupBy(f"{c}.encoding", f"{c}.stratum", f"{c}.bin").count()
    asked = counts(found.select(F.explode("candidates").alias("c")), "c").withColumn("asked", F.lit(True))
    null = counts(found.select("usual").where("usual IS NOT NULL").unionByName(made_tokens(found.sparkSession).where("usual IS NOT NULL")), "usual").withColumn("asked", F.lit(False))
    bins: dict = {}
    for r in asked.unionByName(null).collect():
        bins.setdefault((r["encoding"], r["stratum"]), {True: {}, False: {}})[r["asked"]][r["bin"]] = r["count"]
    out = {}
    for stratum, both in bins.items():
        # longer tokens than any ordinary one are held against the longest of these
        null = both[False] or next((b[False] for s in range(stratum[1] - 1, 3, -1) if (b := bins.get((stratum[0], s))) and b[False]), {})
        total, ordinary_total = sum(both[True].values()), sum(null.values())
        for b in sorted(both[True], reverse=True):
            p = (1 + sum(n for x, n in null.items() if x <= b)) / (1 + ordinary_total)
            if p <= FDR * sum(n for x, n in both[True].items() if x <= b) / total:
                out[stratum] = b
                break
    return out


def random_spans(found: Column, base: Column, limits: dict[tuple[str, int], int]) -> Column:
    """Spans of the candidates that pass their class's threshold and are not inside a span of the fixed patterns."""
    passed = lambda c: F.exists(F.array(*[(c["encoding"] == e) & (c["stratum"] == s) & (c["bin"] <= b) for (e, s), b in sorted(limits.items())]), lambda x: x) if limits else F.lit(False)
    inside = lambda c: F.exists(base, lambda s: (s["start"] <= c["start"]) & (s["end"] >= c["end"]))
    kept = F.filter(found, lambda c: passed(c) & ~inside(c))
    return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end"), (c["end"] - c["start"]).alias("size")))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``base`` (spans of the fixed patterns) and ``spans`` (with the random ones) for each row of ``docs``.

    A null text is empty and has no spans; each repeated row is scanned by itself; extra columns are ignored; an empty
    table gives no rows. Texts are read once: what the rows need for the corpus-wide thresholds is written to the
    shared folder.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    found = staged(docs.select(F.col(key).alias("__key"), base_spans(value).alias("base"), candidates(value).alias("candidates"), ordinary(value).alias("usual")))
    spans = F.array_sort(F.concat("base", random_spans(F.col("candidates"), F.col("base"), thresholds(found))))
    return found.select(F.col("__key").alias(key), "base", spans.alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with every span of their texts replaced by a mask; overlapping spans by one.

    Documents without a secret stay as they are. The texts are scanned twice, once for the thresholds and once where
    they are rewritten, so that no text is shuffled.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    limits = thresholds(staged(docs.select(candidates(value).alias("candidates"), ordinary(value).alias("usual")).where("size(candidates) > 0 OR usual IS NOT NULL")))

    def rewrite(spans: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        step = lambda acc, s: F.struct(F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(value, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        done = F.aggregate(spans, start, step)
        return let(done, lambda d: F.concat(d["out"], F.substring(value, d["at"] + 1, F.length(value))))

    spans = let(base_spans(value), lambda b: F.array_sort(F.concat(b, random_spans(candidates(value), b, limits))))
    clean = let(spans, lambda s: F.when(F.size(s) > 0, rewrite(s)).otherwise(F.col(text)))
    return docs.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{KINDS[i]}") for i in range(3)],
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


QUERIES = {"op4_secret_scan": op4_secret_scan}
SQL: dict[str, str] = {}
