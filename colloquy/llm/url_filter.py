"""URL filter: rules first, then logistic regression on hashed character n-grams (operator 5).

Host and path are cut out and rules matched with column functions. What no rule fits goes to a logistic regression
on 3- to 5-grams of host and path, hashed to a fixed number of weights. It is fitted on a small labelled URL table
(`seeds`, or one that the caller gives), never on the pages themselves, so a verdict does not depend on what else is
judged. In `seeds` every host, ordinary or not, stands with the same paths, prefixes and endings, so that only the
host's own words can tell the classes apart. The weights (512 KB, whatever the input) go to the tasks; scoring is one
pass without a shuffle.

Defined cases: a null URL or one without "://" has empty host and path and is scored as such; an empty path starts
with no rule's path; repeated rows are judged alike; an empty table gives no rows, as does one column of nulls give
verdicts; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

# The rules of the query (host and path, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

# Words that the labelled table's hosts are made of.
BAD = "casino poker slots roulette jackpot lottery blackjack betting bets bookie pills pharma meds viagra tablets steroids adult porn xxx sex cams escort nude hookup loans payday forex replica counterfeit warez crack keygen torrent spam linkfarm ads adserver tracker track popup banner clicks phishing malware".split()
BAIT = "cheap free best top online buy win mega super hot easy fast live vip max cash bonus club farm royal".split()
GOOD = "science garden museum library weather history music books recipes travel school university homework bicycle cityguide news daily journal review kitchen photo nature birds river mountain council church hospital theatre festival football chess archive forum wiki docs code linux maps radio art design craft wood family village market bakery farm winter window trackway essex middlesex address adsorption shop store club online best free top bank insurance hotel bookshop pharmacy clinic".split()
SYLLABLES = "an ar be bel da del do en er es fa fen ga gen ha hel in is jo ka kel la len lo ma mer mo na nes no or pa per ra rin ro sa sen st ta ter th the ti tion ul va ven wa wen".split()
PREFIXES = ("", "www.", "m.", "blog.")
ENDINGS = ("com", "net", "org", "info", "shop", "top", "site", "example.com", "example.net")
PATHS = ("", "/", "/en/1", "/es/2", "/fr/3", "/de/4.html", "/en/5/", "/es/6.html", "/index.html", "/news/7")
NAMES = 800  # made-up hosts of syllables

# Labelled hosts. Ordinary ones are well-known public sites, the others invented names of the kinds that block lists are full of.
ORDINARY = """wikipedia.org wiktionary.org archive.org gutenberg.org openstreetmap.org mozilla.org apache.org kernel.org gnu.org debian.org python.org postgresql.org sqlite.org rust-lang.org golang.org nodejs.org
 github.com gitlab.com bitbucket.org sourceforge.net npmjs.com pypi.org superuser.com serverfault.com askubuntu.com mathoverflow.net quora.com reddit.com medium.com wordpress.com tumblr.com blogspot.com
 google.com bing.com yahoo.com duckduckgo.com microsoft.com apple.com amazon.com ebay.com etsy.com walmart.com target.com costco.com ikea.com bestbuy.com homedepot.com lowes.com
 nytimes.com washingtonpost.com theguardian.com bbc.co.uk reuters.com apnews.com bloomberg.com economist.com ft.com wsj.com cnn.com npr.org pbs.org time.com newyorker.com theatlantic.com nationalgeographic.com
 lefigaro.fr liberation.fr ouest-france.fr spiegel.de zeit.de faz.net sueddeutsche.de tagesschau.de elpais.com elmundo.es lavanguardia.com abc.es repubblica.it lastampa.it nrc.nl volkskrant.nl dn.se politiken.dk
 harvard.edu stanford.edu berkeley.edu yale.edu princeton.edu cornell.edu columbia.edu umich.edu utexas.edu wisc.edu psu.edu ox.ac.uk cam.ac.uk ucl.ac.uk imperial.ac.uk ed.ac.uk essex.ac.uk manchester.ac.uk
 ethz.ch epfl.ch tum.de uni-heidelberg.de sorbonne.fr uva.nl ku.dk uio.no kth.se helsinki.fi utoronto.ca mcgill.ca anu.edu.au u-tokyo.ac.jp nus.edu.sg
 nasa.gov nih.gov cdc.gov noaa.gov usgs.gov loc.gov census.gov irs.gov nps.gov gov.uk nhs.uk parliament.uk europa.eu who.int un.org unesco.org worldbank.org imf.org oecd.org redcross.org
 nature.com science.org sciencedirect.com springer.com wiley.com jstor.org arxiv.org plos.org ieee.org acm.org pubmed.gov britannica.com merriam-webster.com howstuffworks.com instructables.com
 imdb.com rottentomatoes.com spotify.com soundcloud.com bandcamp.com goodreads.com librarything.com allrecipes.com epicurious.com seriouseats.com tripadvisor.com booking.com lonelyplanet.com airbnb.com
 lufthansa.com klm.com airfrance.fr airbus.com siemens.com bosch.com toyota.com honda.com volvo.com michelin.com nestle.com unilever.com pfizer.com novartis.com roche.com deutsche-bank.de hsbc.com""".split()
UNWANTED = """luckyreels88.win spinmaster-vip.bet goldenwheel777.com royalflush-play.net hotsinglesnearyou.date meetlocalgirls.club nastyvideos-hd.tube hardcoreclips4u.com livecamgirls-now.tv milfdates-tonight.com
 getrichquick-today.biz doubleyourcoins.xyz cryptogiveaway-elon.live instantcashadvance.loan nocreditcheck-money.com debtfree-in30days.biz makemoney-fromhome.work passiveincome-secrets.biz
 freegiftcards-generator.club claimyourprize-now.top iphone-winner2024.xyz survey-rewards4you.info congratulations-winner.site secure-login-verify.xyz account-update-alert.info paypa1-support.help bankofamerlca-login.com appleid-unlock.support
 rolexoutlet-sale.shop designerbags-discount90.store nike-clearance-outlet.vip fakewatches-aaa.ru buyfollowers-instant.top likes4cheap.social seo-backlinks-10000.com guestpost-links.agency rankboost-pbn.biz
 keto-gummies-official.store weightloss-miracle.diet testosterone-booster-max.com cialis-noprescription.ru buyxanax-overnight.to oxycodone-cheap-usa.su hairgrowth-trick.online enlargement-secret.men
 downloadcracked-software.ru serialkeys-activator.download freemovies-hdstream.to watchonline-fullmovie.cc mp3juice-download.click moviez4free.icu apk-mod-unlimited.fun hackgame-gems.cheat
 clickredirect-traffic.pro popunder-network.biz banneradz-exchange.net adclickz-server.com trk-affiliate-offers.top push-notify-subscribe.club yourpcisinfected-call.support virus-alert-microsoft.tech
 essay-writers-cheap.help buy-dissertation-online.services fake-diploma-degrees.org passport-forsale.onion-market.ws onlinebetting-tips1x2.bet fixedmatches-sure.win sportsbook-odds24.bet baccarat-asia88.vip""".split()
PATHS_ALONE = 20  # rows of each class without a host, by path: a path tells nothing

WEIGHTS = 1 << 16
GRAMS = (3, 4, 5)
STEPS = 200
RATE = 30.0
DECAY = 1e-4


def seeds() -> list[tuple[str, str, int]]:
    """The labelled URL table: host, path, 1 to block. Each bad word alone and with three of BAIT, each good word alone and with
    another, both with a syllable before or behind, made-up names, and the labelled hosts; all with every path."""
    names = [(w, 1) for w in BAD]
    for k, w in enumerate(BAD):
        for j in range(3):
            bait = BAIT[(3 * k + 7 * j) % len(BAIT)]
            names.append((f"{bait}-{w}" if (k + j) % 3 == 0 else f"{w}-{bait}" if (k + j) % 3 == 1 else bait + w, 1))
    names += [(w, 0) for w in GOOD] + [(f"{w}-{GOOD[(5 * k + 11) % len(GOOD)]}", 0) for k, w in enumerate(GOOD)]
    n = len(SYLLABLES)
    for words, y in ((BAD, 1), (GOOD, 0)):
        for k, w in enumerate(words):
            names += [(w + SYLLABLES[(3 * k + 1) % n], y), (SYLLABLES[(5 * k + 2) % n] + w, y)]
    for k in range(NAMES):
        x = k * 7919 + 13
        names.append(("".join(SYLLABLES[x // n**j % n] for j in range(2 + k % 2)), 0))
    real = [(host, y) for labelled, y in ((ORDINARY, 0), (UNWANTED, 1)) for host in labelled]
    hosts = real + [(f"{PREFIXES[k % len(PREFIXES)]}{w}.{ENDINGS[k // 3 % len(ENDINGS)]}", y) for k, (w, y) in enumerate(names)]
    return [(host, path, y) for host, y in hosts + [("", 0), ("", 1)] * PATHS_ALONE for path in PATHS]


def parts(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits (by code points when equally long), else null. Rules are a short list."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed n-gram of each n-gram of each URL; digits count as one another."""
    raw = [u.encode() for u in urls]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    row = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    data = np.where((data >= 48) & (data <= 57), 48, data).astype(np.uint64)
    rows, got = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + data[k : len(data) - n + 1 + k]
        inside = row[: len(h)] == row[n - 1 :]
        h = (h[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - WEIGHTS.bit_length() + 1)
        rows.append(row[: len(inside)][inside])
        got.append(h.astype(np.int64))
    return (np.concatenate(rows), np.concatenate(got)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def shown(host: str, path: str) -> str:
    """What the n-grams are taken of: marks say where the host begins and ends."""
    return f"^{host}${path}"


def scores(urls: list[str], weights: np.ndarray) -> np.ndarray:
    """Probability to block."""
    rows, g = grams(urls)
    n = np.maximum(np.bincount(rows, minlength=len(urls)), 1)
    return 1 / (1 + np.exp(-(np.bincount(rows, weights[g], minlength=len(urls)) / np.sqrt(n) + weights[-1])))


def fit(urls: list[str], labels: np.ndarray) -> np.ndarray:
    """Weights of the n-grams and, last, of the constant, by accelerated gradient steps on the whole table; both classes weigh the same."""
    w, step = np.zeros(WEIGHTS + 1), np.zeros(WEIGHTS + 1)
    rows, g = grams(urls)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(urls)), 1))
    importance = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, (labels == 0).sum()))
    for _ in range(STEPS):
        ahead = w + 0.9 * step
        p = 1 / (1 + np.exp(-(np.bincount(rows, ahead[g], minlength=len(urls)) * scale + ahead[-1])))
        miss = (p - labels) * importance
        grad = np.append(np.bincount(g, (miss * scale)[rows], minlength=WEIGHTS), miss.sum()) + DECAY * ahead
        step = 0.9 * step - np.append(np.full(WEIGHTS, RATE), 1.0) * grad
        w = w + step
    return w


def url_filter(pages: DataFrame, rules=RULES, labelled: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of the model, for every URL). labelled: host, path, 1 to block; `seeds` if not given."""
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    table = seeds() if labelled is None else labelled
    weights = fit([shown(h, p) for h, p, _ in table], np.array([y for _, _, y in table], dtype=float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = scores([shown(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], weights)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], [*b.schema.names, "score"])

    verdicts = F.create_map(*[F.lit(x) for rule in rules for x in rule])
    got = rows.mapInArrow(score, "page_id long, host string, path string, rule string, score double")
    return got.withColumn("verdict", F.coalesce(verdicts[F.col("rule")], F.when(F.col("score") >= 0.5, "block").otherwise("allow")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
