"""URL filters: rules of hosts and paths, and for the rest logistic regression on hashed character n-grams.

Everything is DataFrame functions and Spark ML on the JVM. A null url, and one without "://", has an empty host and
path, fits no rule, and is judged by the model as an empty string; repeated rows are judged alike; columns besides
the id and the url are kept only if they are asked for.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS, SIZES = 1 << 14, (3, 4, 5)
# A small labelled table, hosts' first labels; 1 is to be blocked.
BLOCKED = "spam-farm cheap-pills buy-pills best-casino online-casino free-money win-prizes hot-deals adult-video xxx-clips fast-loans payday-loans pills-shop spam-blog click-farm link-farm casino-bonus cheap-meds replica-watches free-ringtones crypto-doubler seo-boost lottery-winner miracle-diet get-rich adult-chat".split()
ALLOWED = "news weather library museum university history garden science research travel cooking theatre orchestra river mountain harbour village archive journal gazette poetry painting physics botany geology astronomy school council hospital theater teacher weaving reading hiking".split()
PATHS = ["/", "/en/12", "/de/431", "/fr/7.html", "/es/98/"]


def host(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def examples(spark: SparkSession) -> DataFrame:
    """(host, path, label): each name below three domains, bare and below "www", with paths taken in turn."""
    rows, k = [], 0
    for label, names in ((1, BLOCKED), (0, ALLOWED)):
        for name in names:
            for domain in ("example.com", "example.net", "example.org"):
                for prefix in ("", "www."):
                    rows.append(f"('{prefix}{name}.{domain}', '{PATHS[k % len(PATHS)]}', {label})")
                    k += 1
    return spark.sql("SELECT * FROM VALUES " + ", ".join(rows) + " AS t(host, path, label)")


def grams(text: Column) -> Column:
    """Distinct n-grams of characters."""
    parts = [F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i, n=n: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in SIZES]
    return F.array_distinct(F.concat(*parts))


def _vectors(df: DataFrame) -> DataFrame:
    marked = F.concat(F.transform(grams(F.concat(F.lit("^"), "host", F.lit("$"))), lambda g: F.concat(F.lit("h:"), g)), F.transform(grams(F.col("path")), lambda g: F.concat(F.lit("p:"), g)))
    tf = HashingTF(numFeatures=DIMS, binary=True, inputCol="_grams", outputCol="_features")
    return tf.transform(df.withColumn("_grams", marked))


def fit(labelled: DataFrame) -> LogisticRegressionModel:
    """Trains on a small table (host, path, label)."""
    lr = LogisticRegression(featuresCol="_features", labelCol="label", predictionCol="_label", probabilityCol="_probability", rawPredictionCol="_raw", regParam=0.01, maxIter=50)
    return lr.fit(_vectors(labelled))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct of its string and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judged(pages: DataFrame, model: LogisticRegressionModel, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability of every row."""
    df = _vectors(pages.select(F.col(key).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path")))
    df = model.transform(df).withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    by_model = F.when(F.col("_label") == 1, "block").otherwise("allow")
    from pyspark.ml.functions import vector_to_array

    return df.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", by_model).alias("verdict"), F.round(vector_to_array("_probability")[1], 6).alias("block_probability"))
