"""URL filter: allow and block rules by host and path, and logistic regression
on hashed character n-grams of host and path for every other URL. DataFrame
and SQL functions only; the regression is the DataFrame-based one of
``pyspark.ml``, which runs on the JVM.

The model learns from a small labelled URL table (a parameter of at most
``MAX_LABELLED`` rows; a table of common kinds of URL is the default), so it
is the same whatever the size of the pages, and scoring is a narrow map.

Edge cases: a null URL, or one without ``://``, has an empty host and path,
fits no rule, and is judged by the method on no n-grams. Repeated rows each
give their own row; an empty table gives an empty result; further columns are
not read. URLs of any length are read whole (cut into characters once).
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = 1 << 16
SIZES = (3, 4, 5)
MAX_LABELLED = 10_000
MAX_ITER = 40
REGULARISATION = 0.001
BLOCK_FROM = 0.5

#: (verdict, host, path prefix) of the query's rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: The labelled table: kinds of sites that filter lists name, and kinds of
#: sites that directories list, in general words and with the paths that such
#: sites have. Each host has two prefixes and the paths of its own kind in turn.
BLOCKED_HOSTS = """
royalcasino luckyslots pokerroom roulette-live blackjack24 sportsbet bingo-hall jackpotcity scratchcards betexchange
adserver bannerads popunder clicktracker pixeltrack adnetwork affiliate-ads retarget-ads trafficexchange linkexchange
freegiveaway prizewinner surveyreward giftcard-claim sweepstake cashprize
pharmacy-discount weightloss-pills generic-meds herbal-cure testosterone-boost
payday-advance instantloan creditrepair forex-signals binaryoptions bitcoin-doubler getrichquick
warez-forum crackserial keygens torrentz-mirror cracked-apps freemovies-stream
account-verify secure-login-update phish-bank password-reset-alert wallet-unlock
adultchat webcamgirls escortservice xxxvideos hookup-tonight
seo-backlinks articlespinner bulk-mailer emailblast doorwaypages
""".split()
ALLOWED_HOSTS = """
dailynews eveningpost morningherald localgazette weatherservice
cityuniversity highschool primaryschool openlibrary nationalmuseum artgallery historyarchive
physicsjournal biologyreview medicalresearch astronomyclub mathsociety chemistry-lab
cookingrecipes gardeningtips birdwatching hikingtrails cyclingclub chessleague footballclub
opensource-project developerdocs linuxguide pythontutorial databasehandbook
townhall parliament ministry-health publictransport railwaytimetable
theatre-company symphonyorchestra bookreviews poetry-magazine filmfestival
familydoctor hospital-trust charity-foundation redcross parish-church
architecture-blog travelogue photography-notes woodworking astronomy-blog
""".split()
PREFIXES = ("www.", "")
BLOCKED_PATHS = ("/play/free-spins", "/claim/now.php", "/click?to=offer", "/track/pixel.gif", "/bonus/signup", "/go/aff/8812", "/verify/account.php",
                 "/download/crack.exe", "/win/iphone", "/cheap/buy-now", "/ads/popup.js", "/hot/live-cams", "/deal/100-percent-off")
ALLOWED_PATHS = ("/about", "/news/2019/05/report", "/article/1204", "/docs/guide/chapter-3.html", "/wiki/History", "/research/papers/2017", "/contact",
                 "/recipes/bread", "/events/calendar", "/library/catalogue", "/blog/a-walk", "/courses/introduction", "/archive/1998/letters")
ENDINGS = (".example", ".test")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, A-Z in lower case. Path: from there up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_and_verdict(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict (both null if none does)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(prefix))
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def with_ngrams(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``host`` and ``path``) and their character n-grams as
    ``grams``: those of ``^host path$``, none for an empty URL. The characters
    are a column of their own, cut once and not again for every n-gram."""
    text = F.translate(F.concat(F.lit("^"), F.col("host"), F.lit(" "), F.col("path"), F.lit("$")), UPPER, LOWER)
    chars = F.col("chars")

    def of_size(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(chars) - n + 1), lambda i: F.array_join(F.slice(chars, i, n), ""))

    # A URL with a host or a path has four characters at least here.
    grams = F.flatten(F.array(*[F.when(F.size(chars) >= n, of_size(n)).otherwise(F.array().cast("array<string>")) for n in SIZES]))
    cut = rows.withColumn("chars", F.when((F.col("host") == "") & (F.col("path") == ""), F.array().cast("array<string>")).otherwise(F.split(text, "")))
    return cut.withColumn("grams", grams).drop("chars")


def default_labels(spark: SparkSession) -> DataFrame:
    rows = []
    for label, hosts, paths in ((1.0, BLOCKED_HOSTS, BLOCKED_PATHS), (0.0, ALLOWED_HOSTS, ALLOWED_PATHS)):
        for i, host in enumerate(hosts):
            for j in range(6):  # the site's front page, and five of the paths in turn
                path = "/" if j == 0 else paths[(5 * i + j) % len(paths)]
                rows.append((f"https://{PREFIXES[j % 2]}{host}{ENDINGS[i % 2]}{path}", label))
    return spark.createDataFrame(rows, "url string, label double")


def _features(rows: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(rows)


def train(labelled: DataFrame) -> LogisticRegressionModel:
    """Fit on ``url, label`` (1: block). The table must be small: more than
    ``MAX_LABELLED`` rows are refused."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label")).where("label IS NOT NULL")
    if rows.limit(MAX_LABELLED + 1).count() > MAX_LABELLED:
        raise ValueError(f"the labelled URL table has more than {MAX_LABELLED} rows")
    blocked, n = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    share = min(max((blocked or 0) / max(n, 1), 0.01), 0.99)  # both classes weigh the same
    weighted = rows.withColumn("weight", F.when(F.col("label") > 0, 1 - share).otherwise(share)).coalesce(1)
    regression = LogisticRegression(maxIter=MAX_ITER, regParam=REGULARISATION, standardization=False, weightCol="weight")
    return regression.fit(_features(with_ngrams(weighted)))


def judge(pages: DataFrame, model: LogisticRegressionModel, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """``id_col, host, path, rule, verdict, p_block`` for every row."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    scored = model.transform(_features(with_ngrams(rows))).withColumn("p_block", F.round(vector_to_array("probability")[1], 6))
    rule, verdict = rule_and_verdict(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("p_block") >= BLOCK_FROM, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "p_block")
