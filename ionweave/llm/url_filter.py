"""URL filters: rules first, else segmented names scored by naive Bayes.

Rules (host, path) fit a host and its subdomains when the url's path starts
with the rule's path; the longest rule decides.  Other urls are judged by the
method:

* Hosts and paths are cut into runs of letters, and each distinct run into words
  by a unigram Viterbi search.  Word shares come from the visible text of all
  pages and from hyphenated host labels, which show their own words; words of the
  labelled names have at least the share ``LEXICON``.  Each run gets the counts of
  its own substrings by a join, so no dictionary is collected or broadcast.
* Multinomial naive Bayes over these words, with the class shares as prior, is
  fitted on ``EXAMPLES``, labelled names of several words each.  No word decides by
  being listed: one that both classes use weighs nothing, and an ordinary
  companion outweighs a faint one.  Words that no example has weigh nothing.

Counting and scoring run over distinct hosts and distinct digit-free paths with
their numbers of pages, so a host that owns a third of all pages is one row; only
runs with a weight other than 0 are joined back (``com`` has none), and hot hosts
and paths are dealt over parts.

A word is at most ``WORD`` letters, as a label of a host name is (RFC 1035); longer
runs are cut into overlapping blocks, so work grows with a run's length.

Cases: a null url or one without ``://`` has empty host and path, no rule, and
the verdict of the class shares (allow unless blocks are the majority); repeated rows and null page ids are
judged like others; letters outside a-z separate runs; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fingerprint128, hot_join, look_up, read_table

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Labelled host and path names, the training data of the classifier: names to block, then ordinary ones.
EXAMPLES = {
    "block": """
        adult-video-chat adult-dating-tonight adult-cams-live hot-xxx-cams free-xxx-movies xxx-porn-tube porn-videos-hd live-porn-cams
        casino-bonus-slots online-casino-jackpot casino-poker-slots win-big-casino slots-jackpot-spin poker-betting-bonus
        sports-betting-tips free-betting-odds live-bets-bonus best-bets-today gambling-slots-online gambling-odds-tips
        cheap-viagra-pills buy-viagra-online diet-pills-cheap pills-discount-pharmacy cialis-viagra-shop generic-cialis-pills
        spam-mail-blast bulk-spam-sender link-spam-farm link-spam-exchange popup-ads-network ads-click-money banner-ads-redirect ads-popup-redirect
        malware-download-exe malware-dropper-loader phishing-login-verify phishing-bank-verify verify-wallet-login ransomware-malware-kit
        torrent-movies-free torrent-crack-download warez-crack-keygen warez-serials-download keygen-serials-free
        payday-loans-fast payday-cash-loans replica-watches-cheap replica-handbags-sale escort-girls-tonight escort-dating-girls
    """,
    "allow": """
        city-library-news public-library-books weather-news-today local-weather-forecast university-press-books science-journal-articles
        open-source-software free-software-download software-download-manual operating-system-manual travel-guide-maps hiking-trail-maps
        train-timetable-online bus-timetable-city online-bank-login bank-account-login health-clinic-advice pharmacy-opening-hours
        medicine-journal-online family-doctor-advice football-club-results sports-club-news sports-results-live running-track-field
        cycling-track-club race-track-results organic-farm-shop farm-machinery-sale dairy-farm-market garden-market-today
        cheap-flights-guide cheap-hotel-rooms used-car-market car-sale-advice house-sale-local mail-order-books
        mail-server-manual chat-server-open video-lectures-online video-editing-software movies-review-journal movies-festival-city
        music-festival-live live-concert-hall win-win-negotiation chess-club-win best-recipes-today bread-recipes-kitchen
        girls-school-choir school-holiday-club mobile-network-guide network-cable-shop click-language-research money-museum-city
        watches-museum-history handbags-leather-craft hot-spring-hotel hot-soup-recipes big-bang-physics spin-physics-lab
        tips-gardening-today student-loans-advice library-loans-desk cash-register-museum wallet-leather-craft blast-furnace-history
        link-language-lab exchange-student-guide film-archive-movies photo-archive-history kit-car-club loader-machinery-shop
        fast-train-network shop-opening-hours market-hall-city market-prices-today job-news-local research-grants-office
        government-forms-office tax-office-forms law-faculty-university physics-faculty-lab open-data-maps parks-department-city
        children-books-review poetry-review-journal novel-review-books history-podcast-live science-podcast-news craft-beer-festival
        kitchen-garden-advice river-trail-club mountain-hut-rooms dating-fossils-lab carbon-dating-research generic-drug-research
        discount-rail-card bonus-track-music serials-library-desk crack-climbing-guide jackpot-mine-history tonight-concert-news
        travel-tips-guide cooking-tips-kitchen free-museum-day free-course-online discount-book-shop download-city-maps
        verify-software-signature dropper-bottle-craft redirect-mail-office sender-address-manual tube-station-maps banner-printing-shop
    """,
}
#: Longest word: a label of a host name has at most 63 characters.
WORD = 63
#: Letters of a run whose substrings are listed at once.
BLOCK = 256
#: Least share of a word of EXAMPLES, and share of an unknown word of one letter (a tenth per further letter).
LEXICON, UNKNOWN = 1e-5, 1e-7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


class Bayes:
    """Multinomial naive Bayes of labelled names: prior and weight (log odds of block) per word."""

    def __init__(self, examples: dict[str, list[list[str]]]):
        count = {c: Counter(w for name in names for w in name) for c, names in examples.items()}
        self.words = sorted(count["block"].keys() | count["allow"].keys())
        total = {c: n.total() + len(self.words) for c, n in count.items()}
        self.odds = {w: math.log((count["block"][w] + 1) / total["block"]) - math.log((count["allow"][w] + 1) / total["allow"]) for w in self.words}
        self.prior = math.log((len(examples["block"]) + 1) / (len(examples["allow"]) + 1))


def examples(texts: dict[str, str] = EXAMPLES) -> dict[str, list[list[str]]]:
    return {label: [name.split("-") for name in text.split()] for label, text in texts.items()}


def segment(run: str, shares: dict[str, float]) -> list[str]:
    """The most likely split of ``run`` into words with ``shares`` and unknown ones."""
    unknown = math.log(UNKNOWN)
    costs = {w: math.log(x) for w, x in shares.items()}
    best = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        options = []
        for size in range(1, min(WORD, end) + 1):
            cost = costs.get(run[end - size : end])
            options.append((best[end - size][0] + (unknown - (size - 1) * math.log(10) if cost is None else cost), end - size))
        best.append(max(options))
    out, at = [], len(run)
    while at:
        out.append(run[best[at][1] : at])
        at = best[at][1]
    return out[::-1]


def unigrams(pages: DataFrame, hosts: DataFrame, words: list[str]) -> DataFrame:
    """(word, n): words of all pages' visible text, the parts of hyphenated host labels, and ``words`` (0 at least).

    A label without hyphens adds nothing: it would be its own best split.
    """
    visible = F.regexp_replace(F.lower(F.coalesce("html", F.lit(""))), "<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    seen = pages.select(F.explode(F.split(visible, "[^a-z]+")).alias("word"))
    seen = seen.where(F.length("word").between(2, WORD)).groupBy("word").agg(F.count("*").alias("n"))
    listed = pages.sparkSession.createDataFrame([(w, 0) for w in words], "word string, n long")
    joined = hosts.select(F.explode(F.regexp_extract_all("host", F.lit("[a-z]+(?:-[a-z]+)+"), F.lit(0))).alias("label"))
    own = joined.select(F.explode(F.split("label", "-")).alias("word"), F.lit(1).cast("long").alias("n")).where(F.length("word").between(2, WORD))
    return seen.union(own).union(listed).groupBy("word").agg(F.sum("n").alias("n"))


def _run_id(run: Column) -> Column:
    return fingerprint128(run).alias("id")


def segment_runs(runs: DataFrame, words: DataFrame, model: Bayes) -> DataFrame:
    """(id, words array, odds) of distinct ``runs(run, id)`` of letters; odds sums the words' weights."""
    total = max(words.agg(F.sum("n")).first()[0] or 0, 1)
    block = F.explode(F.transform(F.sequence(F.lit(0), F.length("run") - 1, F.lit(BLOCK)), lambda o: F.substring("run", o + 1, F.lit(BLOCK + WORD - 1)))).alias("block")
    starts = F.sequence(F.lit(1), F.least(F.lit(BLOCK), F.length("block")))
    listed = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(WORD), F.length("block") - s + 1)), lambda n: F.substring("block", s, n))))
    pieces = runs.where(F.length("run") > 0).select("id", block).select("id", F.explode(listed).alias("word")).distinct()
    known = look_up(pieces, words, pieces.groupBy("word").agg(F.count("*").alias("n")), "word", ["id"]).where(F.col("n").isNotNull())
    known = known.groupBy("id").agg(F.collect_list("word").alias("ws"), F.collect_list("n").alias("ns"))
    odds = model.odds

    @F.pandas_udf("words array<string>, odds double")
    def split(run: pd.Series, ws: pd.Series, ns: pd.Series) -> pd.DataFrame:
        out = []
        for r, w, n in zip(run, ws, ns):
            shares = {} if w is None else {x: max(k / total, LEXICON) if x in odds else k / total for x, k in zip(w, n) if k or x in odds}
            found = segment(r, shares)
            out.append((found, sum(odds.get(x, 0.0) for x in found)))
        return pd.DataFrame(out, columns=["words", "odds"])

    return runs.join(known, "id", "left").select("id", split("run", "ws", "ns").alias("s")).select("id", "s.words", "s.odds")


def judge(pages: DataFrame, rules=RULES, model: Bayes | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, method, score) per page; method is the classifier's own verdict, score its log odds."""
    model = model or Bayes(examples())
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("shape", F.regexp_replace(F.lower("path"), "[0-9]+", "0"))
    pairs = cut(urls.groupBy("host", "shape").agg(F.count("*").alias("n")))
    hosts, shapes = (pairs.groupBy(c).agg(F.sum("n").alias("n")) for c in ("host", "shape"))

    def runs_of(names: DataFrame, c: str) -> DataFrame:
        return names.select(F.col(c).alias("name"), F.explode(F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0))).alias("run"))

    in_hosts, in_paths = runs_of(hosts, "host"), runs_of(shapes, "shape")
    runs = cut(in_hosts.union(in_paths).groupBy("run").agg(F.count("*").alias("n")).withColumn("id", _run_id(F.col("run"))))
    words = cut(unigrams(pages, hosts, model.words))
    weights = cut(segment_runs(runs.select("run", "id"), words, model).where("odds <> 0").select("id", "odds"))

    def scores(found: DataFrame, name: str, score: str) -> DataFrame:
        rows = look_up(found.select("name", _run_id(F.col("run"))), weights, runs.select("id", "n"), "id", ["name"])
        return rows.where(F.col("odds").isNotNull()).groupBy(F.col("name").alias(name)).agg(F.sum("odds").alias(score))

    scored = hot_join(urls, scores(in_hosts, "host", "host_odds"), hosts, "host", ["page_id", "path"])
    scored = hot_join(scored, scores(in_paths, "shape", "path_odds"), shapes, "shape", ["page_id", "path"])
    total = F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0)) + F.lit(model.prior)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.when(total > 0, "block").otherwise("allow").alias("method"), total.alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", "method").alias("verdict"), "method", "score")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLE_SQL: dict[str, str] = {}
