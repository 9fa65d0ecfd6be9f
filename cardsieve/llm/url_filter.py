"""URL filter: host and path rules, and a logistic regression on hashed n-grams for the rest."""

import random
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardsieve.llm.common import ascii_lower, by_value

by_value(__name__)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlModel:
    """Settings. `most_rows` bounds the labelled table and `most_rules` the rule list."""

    shortest: int = 3
    longest: int = 5
    bits: int = 15
    rounds: int = 600
    rate: float = 6000.0
    decay: float = 2e-7
    threshold: float = 0.5
    most_rows: int = 20_000
    most_rules: int = 10_000


# What the labelled table is made of: invented names, told apart by topic. Each topic has its
# telling words, in several spellings, and the words that stand beside them.
_BAD = {
    "casino casinos kasino poker bet bets betting bingo jackpot slot slots roulette blackjack lotto wager gamble gambling": "best royal lucky online vip club king spin mega win bonus gold live 24 777",
    "xxx porn porno adult adults sex sexy escort escorts nude nudes erotic erotik hotgirls camgirls milf fetish": "hot live free cam cams tube club girls date x 18 hub video max zone",
    "viagra cialis pill pills pharma pharmacy drugs meds tablets steroids dietpills rx botox slimming": "cheap discount online best buy order generic 24 direct fast store now canada shop",
    "loan loans payday credit-now quickcash cashadvance debt refinance forex crypto-profit bitcoin-double getrich": "fast easy instant cheap now online approve 24 best no-check today money",
    "warez keygen crack cracked cracks torrent torrents nulled serials pirate hacked fullrip": "free download best hub zone world top full now direct bay",
    "replica replicas fake knockoff counterfeit outlet-sale rolexcopy": "watch watches bags cheap best luxury shop store discount brand",
    "ads ad adserver adserv adclick advert adverts banner banners popup popunder doubleclick adsync": "serve server network net click media delivery exchange cdn sync partner best track",
    "track tracker tracking trackers pixel beacon analytics-spy clickstat telemetry fingerprint retarget adtracking": "click clicks user users web site data cdn log hub stats mail global",
    "spam spammer spammy bulkmail massmail linkfarm contentfarm clickbait scam phish phishing malware lottery-winner giveaway": "mail farm link links free world host hub blast list best traffic bot",
    "free-coins free-money free-gift free-spins free-iphone prize prizes freebies cashprize winner-claim": "claim now today get online best big hub click here",
}
_GOOD = "news docs wiki library school museum garden recipes weather travel science history music sports health forum research gallery events city bank market kitchen farm farmers house river mountain village church hospital clinic university college student teacher lawyer doctor dentist bakery coffee tea wine beer hotel hostel camping hiking cycling running football tennis chess theatre cinema film photo design paint craft wood metal stone glass paper print book books poetry novel magazine journal radio podcast video game games toys kids family parents baby wedding fashion shoes jewelry furniture tools repair auto cars train trains rail airport ship boats harbor energy solar wind water forest animal animals dogs cats birds horses fish insects plants flowers seeds trees software code open data cloud mobile network systems robotics physics chemistry biology math language english german french spanish translate culture art society politics law rights economy finance insurance pension office jobs career startup industry factory steel textile food fruit vegetables bread cheese honey sustainable climate earth space stars moon planet ocean island beach desert winter summer spring autumn zeitung nachrichten schule stadt wetter garten kochen reisen verein musik jardin cuisine maison voyage ecole musee noticias escuela ciudad tiempo cocina deportes salud address addition adventure adapt shadow ladder radius pillow pillar sextant essex essen window winner-tennis darwin twins badminton gadget broadway tracks-railway racetrack attraction alphabet betterment diabetes spamalot slotted assistant classic loaner freedom freight freeware-docs".split()
_BESIDE = "the my our old new blue green north south east west data day home world city hub best net online free live club shop store guide daily central first open now time page town".split()
_SYLLABLES = "ba ber bo chen da del den dor el en er fa fen gar gel ha heim ia in ka kel la len lo ma men mi na nor o or pa per ra ren ri sa sen shi ster sto ta tal ter ti ton tor tra va ver vi vo wa wel wick zen zo and ing ion ous tho thi tha the ness ly ble st sh".split()
_ENDS = "com net org info io de fr es it co.uk com.br eu biz site online shop top xyz club me".split()
_FRONTS = ["", "", "www.", "www.", "m.", "blog.", "shop.", "cdn.", "go."]
# Hosts of the given pages, without dashes, which the table may not have.
_GIVEN = set("adstrack adultx casinowin cheappills freebets spamfarm".split())


def labelled_urls() -> list[tuple[str, bool]]:
    """Addresses on invented hosts; True is to be blocked.

    Ends, fronts and paths are drawn alike for both sides, so that they tell nothing.
    """
    draw = random.Random(9)
    names: dict[str, bool] = {}
    for words, beside in _BAD.items():
        for word in words.split():
            names[word] = True
            for tail in draw.sample(beside.split(), 6):
                pair = [word, tail] if draw.random() < 0.6 else [tail, word]
                names[draw.choice(["-", "-", ""]).join(pair)] = True
    for word in _GOOD:
        names[word] = False
        for _ in range(4):
            pair = draw.sample([word, draw.choice(_BESIDE + _GOOD)], 2)
            names[draw.choice(["-", ""]).join(pair)] = False
    for _ in range(1200):
        name = "".join(draw.choices(_SYLLABLES, k=draw.randint(2, 4)))
        names.setdefault(name, False)
    rows = []
    for name, bad in names.items():
        if name.replace("-", "") in _GIVEN:
            continue
        path = draw.choice(("", "/", "/{w}", "/{n}", "/{w}/{n}", "/{n}.html", "/{w}/{w}.php?id={n}"))
        path = path.replace("{w}", draw.choice(_BESIDE)).replace("{n}", str(draw.randint(1, 9999)))
        front, end = draw.choice(_FRONTS), draw.choice(_ENDS)
        rows.append((f"http{draw.choice(['', 's'])}://{front}{name}.{end}{path}", bad))
    return rows


def url_parts(url) -> tuple:
    """Columns host and path: of the text behind the first `://`, else both empty."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)


def features(hosts: Sequence[str], paths: Sequence[str], how: UrlModel):
    """Hash buckets of the n-grams of each address, one after the other, and their owners."""
    rows = [f"\1{h}\2{p}\3".encode() for h, p in zip(hosts, paths)]
    data = np.frombuffer(b"".join(rows), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    owner = np.repeat(np.arange(len(rows)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    # Host and path n-grams of the same letters are different features.
    in_path = np.cumsum(data == 2) > np.cumsum(data == 1) - 1
    buckets, owners = [], []
    for n in range(how.shortest, how.longest + 1):
        size = max(len(data) - n + 1, 0)
        out = np.full(size, n, np.uint32) + in_path[:size].astype(np.uint32) * np.uint32(97)
        for i in range(n):
            out = (out ^ data[i : i + size]) * np.uint32(0x01000193)
        out = ((out ^ (out >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - how.bits)
        own = left[:size] >= n
        buckets.append(out[own].astype(np.int64))
        owners.append(owner[:size][own])
    return np.concatenate(buckets), np.concatenate(owners)


def _scores(weights: np.ndarray, buckets, owners, rows: int) -> np.ndarray:
    """The linear part: the mean weight of an address's n-grams, and the bias."""
    total = np.bincount(owners, weights[buckets], rows)
    return total / np.maximum(np.bincount(owners, minlength=rows), 1) + weights[-1]


def train(labelled: DataFrame, how: UrlModel = UrlModel()) -> np.ndarray:
    """Weights from (url, blocked) rows: at most `most_rows` of them, taken by hash.

    Null labels are left out; no rows give zero weights, by which every address is allowed.
    """
    host, path = url_parts(F.col("url"))
    rows = labelled.where("blocked IS NOT NULL").select(
        host.alias("host"), path.alias("path"), F.col("blocked").cast("double").alias("blocked")
    )
    some = rows.orderBy(F.xxhash64("host", "path"), "host", "path", "blocked").limit(how.most_rows)
    some = some.toPandas()
    weights = np.zeros((1 << how.bits) + 1)
    if not len(some):
        weights[-1] = -1.0
        return weights
    target = some["blocked"].to_numpy()
    buckets, owners = features(some["host"], some["path"], how)
    share = 1.0 / np.maximum(np.bincount(owners, minlength=len(some)), 1)[owners]
    for _ in range(how.rounds):
        wrong = 1 / (1 + np.exp(-_scores(weights, buckets, owners, len(some)))) - target
        slope = np.bincount(buckets, wrong[owners] * share, len(weights)) / len(some)
        weights[:-1] -= how.rate * (slope[:-1] + how.decay * weights[:-1])
        weights[-1] -= how.rate * wrong.mean() / 1000
    return weights


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], weights: np.ndarray, how: UrlModel = UrlModel()
) -> DataFrame:
    """Per page: page_id, host, path, rule, score, verdict.

    A rule fits its host and all hosts below it if the path starts with the rule's path; the
    longest rule wins, and of equally long ones a blocking one. Without a rule, the model
    decides. Null addresses and those without `://` have an empty host and path. Rows that
    repeat stay; other columns are left out; an empty table gives an empty result.
    """
    if len(rules) > how.most_rules:
        raise ValueError(f"more than {how.most_rules} rules")
    best_first = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    rank = {rule: i for i, rule in enumerate(best_first)}
    by_host: dict[str, list[Rule]] = {}
    for rule in best_first:
        by_host.setdefault(rule.host, []).append(rule)

    def rule_of(host: str, path: str) -> Rule | None:
        best = None
        labels = host.split(".")
        for i in range(len(labels)):
            for rule in by_host.get(".".join(labels[i:]), ()):
                if path.startswith(rule.path):
                    if best is None or rank[rule] < rank[best]:
                        best = rule
                    break
        return best

    def work(batches):
        for batch in batches:
            hosts, paths = batch["host"].to_pylist(), batch["path"].to_pylist()
            buckets, owners = features(hosts, paths, how)
            scores = 1 / (1 + np.exp(-_scores(weights, buckets, owners, len(hosts))))
            found = [rule_of(h, p) for h, p in zip(hosts, paths)]
            judged = [
                r.verdict if r else "block" if s >= how.threshold else "allow"
                for r, s in zip(found, scores)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([r.text if r else None for r in found], pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(judged, pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "score", "verdict"],
            )

    host, path = url_parts(F.col("url"))
    return pages.select(
        F.col("page_id").cast("long"), host.alias("host"), path.alias("path")
    ).mapInArrow(
        work, "page_id long, host string, path string, rule string, score double, verdict string"
    )


def training_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, blocked boolean")
