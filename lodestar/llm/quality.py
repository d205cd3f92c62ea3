"""Quality rules with host verdicts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import renamed, words_of
from lodestar.plans.scratch import materialize

#: Characters that prose hardly uses.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
#: Of 100 words, so many may lie in five-word windows that the text holds more than once.
MAX_REPEATED = 20
WINDOW = 5
#: A host is rejected if the shrunk rate of its failing documents is above this.
MAX_HOST_RATE = 0.5
#: Bytes of verdicts that are sent to all tasks; and hosts that count as hot have one of so many rows at least.
FEW_HOSTS, HOT = 16 << 20, 1000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: str, hashes: str) -> Column:
    """Words covered by windows found twice or more. Only texts with such windows pay for the sort."""
    ranked = F.sort_array(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(F.col(hashes))) < F.size(hashes), ranked)


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns COUNTS and `base_failed`, counted over each whole text; a null text has no words.

    A text of fewer than five words has no window. Equal windows are found by 64-bit hashes within one text.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.withColumn("__w", words_of(text)).withColumn("__n", F.size("__w"))
    df = df.withColumn("__h", F.when(F.col("__n") >= WINDOW, F.transform(F.sequence(F.lit(1), F.col("__n") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("__w"), i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__s", _repeated("__w", "__h"))
    s = F.col("__s")
    again = F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)))
    df = df.withColumn("__p", F.when(s.isNotNull(), F.sort_array(F.transform(again, lambda x: x["i"]))))
    p = F.col("__p")
    reach = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
    df = df.withColumn("__l", F.filter(F.split(text, "\n"), lambda x: F.translate(x, "\t\x0b\x0c\r ", "") != ""))
    counts = {
        "n_words": F.col("__n").cast("long"),
        "word_chars": F.length(F.translate(text, "\t\n\x0b\x0c\r ", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
    }
    low = set(counts) | {"base_failed", "__w", "__n", "__h", "__s", "__p", "__l"}
    df = df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low], *[v.alias(k) for k, v in counts.items()])
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def host_of(source: Column) -> Column:
    """The host of a URL, or the name itself; null counts as one host, ''."""
    return F.lower(F.regexp_extract(F.coalesce(source, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1))


def host_verdicts(judged: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """`__host`, `host_rejected` of a table with `__host` and `base_failed`.

    Of the hosts' failure rates, the method of moments gives a beta prior: with mean m and variance v over hosts,
    a + b = m (1 - m) / v - 1, held between 1 and 1000 (1000 if all rates agree). A host's rate is
    (failed + a) / (documents + a + b). One row a host, so that a hot host is summed before it is shuffled.
    """
    hosts = judged.groupBy("__host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("k"))
    rate = F.col("k") / F.col("n")
    m, v = F.avg(rate), F.var_pop(rate)
    prior = hosts.agg(F.struct(m.alias("m"), F.when(v > 1e-9, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), m * (1 - m) / v - 1))).otherwise(1000.0).alias("s")).alias("p"))
    p = prior.scalar()
    shrunk = (F.col("k") + p["m"] * p["s"]) / (F.col("n") + p["s"])
    return hosts.select("__host", "n", (shrunk > max_rate).alias("host_rejected"))


def with_verdicts(judged: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """judged with `host_rejected`. Few hosts are sent to all tasks, and so are, of many, those of one row in HOT or more.

    So no host's rows meet in one task: at most HOT hosts are that frequent, and the rest is joined by host.
    """
    verdicts = materialize(host_verdicts(judged, max_rate), "hosts")
    n, size, rows = verdicts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("__host")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if size + 16 * n <= FEW_HOSTS:
        return judged.join(F.broadcast(verdicts.drop("n")), "__host")
    hot = F.broadcast(verdicts.where(F.col("n") * HOT >= rows).select("__host", F.col("host_rejected").alias("__v")))
    marked = judged.join(hot, "__host", "left")
    rest = marked.where(F.col("__v").isNull()).drop("__v").join(verdicts.where(F.col("n") * HOT < rows).drop("n"), "__host")
    return rest.unionByName(marked.where(F.col("__v").isNotNull()).withColumnRenamed("__v", "host_rejected"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per row of docs: the id, COUNTS, `base_failed`, `host_rejected`, `kept`; plus `__row`, a hash of the text.

    The counts are computed once and written, without texts, to the shared folder; hosts are judged on them.
    Empty tables give no rows; null texts have no words and fail; null hosts are one host. Each row is judged and counts
    for its host by itself, also where ids or rows repeat; texts may be as long as a row can be.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__t"), host_of(F.col(f"`{host_col}`")).alias("__host"))
    judged = materialize(features(slim, "__t").withColumn("__row", F.xxhash64("__t")).drop("__t"), "quality")
    out = with_verdicts(judged, max_rate)
    return out.select(F.col("__id").alias(id_col), "__row", *COUNTS, "base_failed", "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of docs that judge() keeps, with the columns they have, of whatever names."""
    df, names = renamed(docs)
    key, text, host = (names[docs.columns.index(c)] for c in (id_col, text_col, host_col))
    bad = judge(df, key, text, host, max_rate).where(~F.col("kept")).select(F.col(key).alias("__id"), "__row").distinct()
    keyed = df.withColumn("__r", F.xxhash64(text))
    return keyed.join(bad, keyed[key].eqNullSafe(bad["__id"]) & (keyed["__r"] == bad["__row"]), "left_anti").drop("__r").toDF(*docs.columns)
