"""URL filter: explicit host and path rules, then host word segmentation with a unigram
Viterbi search and multinomial naive Bayes over the segmented host and path tokens.

The word list is a public vocabulary in order of frequency (its path is a parameter); a
word's probability falls with its place, and letters outside the list cost by the letter.
Naive Bayes starts from a short list of typical names and learns the token counts of both
verdicts from all given URLs by a few rounds of expectation-maximisation, as Spark
aggregations whose size is bounded by the word list.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import arrow_column, write_table

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
LONGEST = 16
ROUNDS = 2
PRIOR = 0.05  # of blocked URLs
SEED_WEIGHT = 50.0  # how often each typical name counts
SMOOTHING = 0.5
CACHED_HOSTS = 100_000
OTHER = "#"  # a run of letters that is no word

# fixed values: (rule host, rule path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

# fixed values: typical name parts of hosts to block and to allow
BLOCK_NAMES = """ad ads adserver adult affiliate bet bets betting bingo bitcoin bonus casino cam cams cash cheap cialis click clickbait coupon crack credit
crypto dating deal deals debt diet discount drugs earn erotic escort fake farm forex free gambling hack hot jackpot keygen loan loans lottery lucky malware
miracle money nude offer offers payday pharmacy phishing pills pirate poker popup porn prize promo replica rich scam sex slots spam spy torrent track tracker
tracking traffic viagra virus warez weight win winner wins xxx""".split()
ALLOW_NAMES = """academy archive art arts blog books church city civic class college community culture daily data docs edu education forum garden gazette gov
health herald history home hospital house journal kitchen lab labs law learn library life local magazine map media medical museum music nature news office
open paper park people photo post press project radio recipes research review river road school science society sport sports story street studio study team
tech times town travel tv university valley water weather wiki work world""".split()

_LETTERS = re.compile(r"[^\W\d_]+")
_SKIP = frozenset("www m com org net example html htm php index".split())


def read_words(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's whole words of a-z in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = [t[:-4] for t, _ in sorted(vocab.items(), key=lambda x: x[1]) if t.endswith("</w>")]
    return list(dict.fromkeys(w for w in words if w.isascii() and w.isalpha() and len(w) <= LONGEST and (len(w) > 2 or w in _SHORT)))


_SHORT = frozenset("a i ad am an as at be by do go he hi if in is it me my no of on or so to tv uk up us we x".split())


@dataclass
class Segmenter:
    """Unigram Viterbi over a word list."""

    cost: dict[str, float]
    letter: float  # cost of a letter outside all words

    @classmethod
    def of(cls, words: list[str]) -> Segmenter:
        ranked = list(dict.fromkeys([*BLOCK_NAMES, *ALLOW_NAMES, *words]))
        total = sum(1 / (i + 100) for i in range(len(ranked)))
        place = {w: i for i, w in enumerate(words)}
        cost = {w: -math.log(1 / (place.get(w, len(words) // 4) + 100) / total) for w in ranked}
        return cls(cost, 12.0)

    def split(self, run: str) -> list[str]:
        """The cheapest split of a run of letters into words; letters outside words come
        together as ``OTHER``."""
        n = len(run)
        best, back = [0.0] + [math.inf] * n, [(0, False)] * (n + 1)
        for e in range(1, n + 1):
            best[e], back[e] = best[e - 1] + self.letter, (e - 1, False)
            for s in range(max(0, e - LONGEST), e):
                c = self.cost.get(run[s:e])
                if c is not None and best[s] + c < best[e]:
                    best[e], back[e] = best[s] + c, (s, True)
        out, e = [], n
        while e:
            s, word = back[e]
            if word:
                out.append(run[s:e])
            elif not out or out[-1] != OTHER:
                out.append(OTHER)
            e = s
        return out[::-1]

    def tokens(self, text: str) -> list[str]:
        return [t for run in _LETTERS.findall(text.lower()) if run not in _SKIP for t in self.split(run)]


@dataclass
class UrlModel:
    segmenter: Segmenter
    log_ratio: dict[str, dict[str, float]] = field(default_factory=dict)  # kind -> token -> log P(block) - log P(allow)
    unseen: dict[str, float] = field(default_factory=dict)
    prior: float = PRIOR

    def scorer(self):
        hosts: dict[str, list[str]] = {}

        def read(host: str, path: str):
            if host not in hosts:
                if len(hosts) > CACHED_HOSTS:
                    hosts.clear()
                hosts[host] = self.segmenter.tokens(host)
            return {"host": hosts[host], "path": self.segmenter.tokens(path)}

        def block_probability(tokens) -> float:
            z = math.log(self.prior / (1 - self.prior))
            for kind, ts in tokens.items():
                known, unseen = self.log_ratio.get(kind, {}), self.unseen.get(kind, 0.0)
                z += sum(known.get(t, unseen) for t in ts)
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

        return read, block_probability

    def learn(self, counts: dict[str, dict[str, tuple[float, float]]], share: float) -> UrlModel:
        """From kind -> token -> (weight among blocked, weight among allowed)."""
        seeds = {"host": {}, "path": {}}
        for kind in seeds:
            for names, k in ((BLOCK_NAMES, 0), (ALLOW_NAMES, 1)):
                for w in names:
                    seeds[kind].setdefault(w, [0.0, 0.0])[k] += SEED_WEIGHT
        ratio, unseen = {}, {}
        for kind, seed in seeds.items():
            both = {t: np.array(v, float) for t, v in seed.items()}
            for t, v in counts.get(kind, {}).items():
                both[t] = both.get(t, np.zeros(2)) + np.array(v)
            total = sum(both.values()) + SMOOTHING * (len(both) + 1)
            ratio[kind] = {t: float(np.log((v[0] + SMOOTHING) / total[0]) - np.log((v[1] + SMOOTHING) / total[1])) for t, v in both.items()}
            unseen[kind] = 0.0
        return UrlModel(self.segmenter, ratio, unseen, min(0.5, max(1e-3, share)))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null or without ://."""
    u = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _expected_counts(urls: DataFrame, model: UrlModel):
    """One expectation step: token weights of either verdict, and the share of blocked URLs."""
    shared = urls.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("token", pa.string()), ("p", pa.float64())]))

    def batches(it):
        read, block = shared.value.scorer()
        for rows in it:
            out = []
            for host, path in zip(rows.field(0).to_pylist(), rows.field(1).to_pylist()):
                tokens = read(host, path)
                p = block(tokens)
                out.append([{"kind": k, "token": t, "p": p} for k, ts in tokens.items() for t in ts] + [{"kind": "all", "token": "", "p": p}])
            yield pa.array(out, kind)

    fn = arrow_column(urls.sparkSession, batches, "array<struct<kind: string, token: string, p: double>>")
    each = urls.select(F.explode(fn(F.struct("host", "path"))).alias("t"))
    rows = each.groupBy("t.kind", "t.token").agg(F.sum("t.p").alias("p"), F.count("*").alias("n")).collect()  # bounded by the word list
    counts: dict[str, dict[str, tuple[float, float]]] = {}
    for r in rows:
        counts.setdefault(r.kind, {})[r.token] = (r.p, r.n - r.p)
    blocked, allowed = counts.pop("all", {"": (0.0, 1.0)})[""]
    return counts, blocked / max(1e-9, blocked + allowed)


def fit(pages: DataFrame, url_col: str = "url", vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> UrlModel:
    """Learn from all URLs of ``pages``; each distinct host and path counts once."""
    host, path = url_parts(F.col(url_col).cast("string"))
    urls = write_table(pages.select(host.alias("host"), path.alias("path")).where("host <> ''").distinct(), "urls")
    model = UrlModel(Segmenter.of(read_words(vocabulary))).learn({}, PRIOR)
    model.log_ratio["path"] = {}  # paths say nothing before the hosts have been judged
    for _ in range(rounds):
        model = model.learn(*_expected_counts(urls, model))
    return model


def judge(pages: DataFrame, model: UrlModel, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: ``id_col``, host, path, rule (null if none fits), verdict ("allow" or
    "block": the rule's, else that of naive Bayes), p_block.

    A null URL or one without :// has an empty host and path, fits no rule and is judged by
    the prior alone (allow).  Repeated rows and null ids stay; other columns are ignored; an
    empty table gives none."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def batches(it):
        read, block = shared.value.scorer()
        for rows in it:
            yield pa.array([block(read(h, p)) for h, p in zip(rows.field(0).to_pylist(), rows.field(1).to_pylist())], pa.float64())

    host, path = url_parts(F.col(url_col).cast("string"))
    src = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    src = src.select("*", arrow_column(pages.sparkSession, batches, "double")(F.struct("host", "path")).alias("p_block"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return src.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "p_block")
