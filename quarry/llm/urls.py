"""URL filters: rules on hosts and paths, and, where none fits, naive Bayes over segmented host and path tokens.

A host's labels are split into words by a unigram Viterbi whose counts come from the URLs' paths and a seed list. The counts of
all path words stay distributed: each host gets those of its own substrings by a join. The classifier learns from a bounded
sample of the URLs that the rules decide, beside the seed list.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Bounded, keep, ship, utf8

#: Words that the segmenter knows beside the table's own, and the labelled examples that the classifier learns from (fixed values).
BLOCK_EXAMPLES = """free casino bonus; online casino slots; adult video xxx; hot sex cams; porn tube; cheap viagra pills; spam farm links; buy
followers cheap; poker bet win; sports betting odds; crack keygen download; warez torrent; payday loan fast cash; miracle weight loss pills;
replica watches cheap; malware download; phishing login verify; escort girls; adult x; click bait farm; link farm seo; essay writing cheap;
lottery jackpot win; crypto doubler profit; gambling roulette slots; nude cams live""".replace("\n", " ")
ALLOW_EXAMPLES = """blog; news daily; www; world news today; university research; open source docs; python docs library; city library; health
information; science journal; recipes kitchen; travel guide; weather report; school education; history museum; music review; film review;
garden tips; photo gallery; local government services; developer forum; wiki encyclopedia; book club; sports results; company about contact;
article archive; help support""".replace("\n", " ")
#: A label has at most so many characters and a host so many, by their standard; what is longer is no name to split, but one word.
LONGEST, LONGEST_HOST = 63, 253
#: The prior of block; the most different URLs that the classifier learns from (those that hash lowest, outside of fold 0 of FOLDS).
PRIOR, SAMPLE, FOLDS = 0.2, 5_000, 5
#: In the classifier, counts of the URLs' words and of the seed list add up to as much for each verdict.
LEARNT = 1_000.0
#: The segmenter's counts add up to TOTAL, whatever the size of the table; the seed list has this share of it.
TOTAL, SEED_SHARE = 150_000.0, 0.5
#: Counts that a worker's segmenter holds before it starts anew.
HELD = 500_000

TOKEN = re.compile("[a-z]+")


def parts(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lowered, and the path of a URL; both empty if it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


class Segmenter:
    """Splits a name into the likeliest words; a word that is not known costs more the longer it is."""

    def __init__(self, counts: dict[str, float], total: float | None = None):
        self.total = total or sum(counts.values()) + 1
        self.unknown = math.log(self.total) + 2
        self.cost: dict[str, float] = {}
        self.kept = Bounded(100_000)
        self.learn(counts)

    def learn(self, counts: dict[str, float]) -> None:
        """Counts of more words; names that hold one of them must not have been split before."""
        self.cost.update((w, min(-math.log(c / self.total), self.unknown + 3.0 * len(w))) for w, c in counts.items() if 0 < len(w) <= LONGEST)

    def split(self, name: str) -> list[str]:
        if (known := self.kept.get(name)) is not None:
            return known
        best, back = [0.0], [0]
        if len(name) > LONGEST:
            return [name]
        for end in range(1, len(name) + 1):
            found, start = math.inf, end - 1
            for i in range(end):
                cost = best[i] + self.cost.get(name[i:end], self.unknown + 3.0 * (end - i))
                if cost < found:
                    found, start = cost, i
            best.append(found)
            back.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        out.reverse()
        self.kept.room()
        if len(name) <= 64:
            self.kept[name] = out
        return out


class Bayes:
    """Multinomial naive Bayes with add-one smoothing over words of labelled examples; words outside of them say nothing."""

    def __init__(self, examples: list[tuple[str, list[str]]] = ()):
        """From (verdict, words); of each verdict they weigh as much as the seed list."""
        counts = {}
        for verdict, seeds in (("block", BLOCK_EXAMPLES), ("allow", ALLOW_EXAMPLES)):
            counts[verdict] = Counter()
            for some in (Counter(TOKEN.findall(seeds)), Counter(w for v, words in examples if v == verdict for w in words)):
                for w, c in some.items():
                    counts[verdict][w] += c * LEARNT / some.total()
        a, b = counts["allow"], counts["block"]
        words = a.keys() | b.keys()
        n, m = sum(a.values()) + len(words), sum(b.values()) + len(words)
        self.weight = {w: math.log((b[w] + 1) / m) - math.log((a[w] + 1) / n) for w in words}
        self.prior = math.log(PRIOR / (1 - PRIOR))

    def score(self, words: list[str]) -> float:
        """The log odds of block."""
        return self.prior + sum(self.weight.get(w, 0.0) for w in words)


class Rules:
    """(verdict, host and path) pairs; a rule fits its host and all subdomains if the path starts with the rule's; longest wins."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.at: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.at.setdefault(host, []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, rest = None, host
        while True:
            for start, rule, verdict in self.at.get(rest, ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            _, dot, rest = rest.partition(".")
            if not dot:
                return best


def names(host: str) -> list[str]:
    """What a host's labels but the last are made of, a host of one label taken whole."""
    return TOKEN.findall(host.rpartition(".")[0] or host)


def substrings(host: str) -> set[str]:
    """Whatever may be a word in a host's names, and the empty text, so that each host has one."""
    if len(host) > LONGEST_HOST:
        return {""}
    return {n[i:j] for n in names(host) if len(n) <= LONGEST for i in range(len(n)) for j in range(i + 2, len(n) + 1)} | {""}


def host_words(host: str, split: Callable[[str], list[str]]) -> list[str]:
    return [w for n in names(host) for w in (split(n) if len(host) <= LONGEST_HOST else [n])]


def segmented(pages: DataFrame) -> DataFrame:
    """h (binary), split: each host once, and its names' words with spaces between.

    Words count as often as they occur in all paths, where they stand apart; TOTAL is shared out among them and the seeds.
    """
    host, path = parts(F.col("url"))
    seeds = Counter(TOKEN.findall(BLOCK_EXAMPLES + " " + ALLOW_EXAMPLES))
    tokens = F.explode(F.regexp_extract_all(F.lower(path), F.lit("[a-z]{2,}"), F.lit(0)))
    counts = keep(pages.select(tokens.alias("w")).groupBy("w").count(), "words")
    every = counts.agg(F.sum("count")).first()[0] or 1
    seed = {w: c * TOTAL * SEED_SHARE / seeds.total() for w, c in seeds.items()}
    each = TOTAL * (1 - SEED_SHARE) / every

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                pairs = [(h, w) for h in b.column(0)[at : at + 1_000].to_pylist() for w in sorted(substrings(h.decode("utf-8", "replace")))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*pairs, strict=True), (pa.binary(), pa.string()), strict=True)], ["h", "w"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(seed, TOTAL)
        for b in batches:
            out = []
            for h, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(segmenter.cost) > HELD:
                    segmenter = Segmenter(seed, TOTAL)
                segmenter.learn({x["w"]: seed.get(x["w"], 0.0) + each * x["count"] for x in known})
                out.append(" ".join(host_words(h.decode("utf-8", "replace"), segmenter.split)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["h", "split"])

    pairs = pages.select(utf8(host).alias("h")).distinct().mapInArrow(cut, "h binary, w string").join(counts, "w", "left")
    known = pairs.groupBy("h").agg(F.collect_list(F.when(F.col("count").isNotNull(), F.struct("w", "count"))).alias("known"))
    return known.mapInArrow(split, "h binary, split string")


def text_of(b: pa.RecordBatch, *columns: int) -> Iterator[tuple[str, ...]]:
    return zip(*([x.decode("utf-8", "replace") for x in b.column(i).to_pylist()] for i in columns), strict=True)


def ruled(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, h, p (binary), words, rule, verdict (null where no rule fits), for every row of page_id and url."""
    host, path = parts(F.col("url"))
    held = Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(" ".join(s.split() + TOKEN.findall(p.lower())), *(held.find(h, p) or (None, None))) for (h, p), s in zip(text_of(b, 1, 2), b.column(3).to_pylist(), strict=True)]
            columns = zip(*out, strict=True) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, pa.string()) for c in columns)], ["page_id", "h", "p", "words", "rule", "verdict"])

    rows = pages.select("page_id", utf8(host).alias("h"), utf8(path).alias("p")).join(segmented(pages), "h", "left").select("page_id", "h", "p", "split")
    return keep(rows.mapInArrow(run, "page_id long, h binary, p binary, words string, rule string, verdict string"), "ruled")


def fold():
    return F.pmod(F.xxhash64("h", "p", F.lit(2)), F.lit(FOLDS))


def fit(rows: DataFrame) -> Bayes:
    """A classifier from `ruled` URLs: at most SAMPLE different ones that a rule decides, none of fold 0."""
    decided = rows.where(F.col("verdict").isNotNull() & (fold() != 0)).select("h", "p", "words", "verdict", F.xxhash64("h", "p").alias("hash"))
    many = decided.agg(F.approx_count_distinct("hash")).first()[0]
    share = min(1.0, 2 * SAMPLE / max(1, many))
    few = decided.where(F.pmod("hash", F.lit(1 << 20)) <= int(share * (1 << 20))).dropDuplicates(["h", "p"])
    some = few.orderBy(F.pmod("hash", F.lit(1 << 20)), "hash", "h", "p").limit(SAMPLE).collect()
    return Bayes([(r["verdict"], r["words"].split()) for r in some])


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, words, score, for every row of page_id and url.

    verdict is the longest fitting rule's, else block if the log odds (score) are above 0. Null URLs and URLs without :// have
    an empty host and path and are judged by the prior alone. Labels of more than LONGEST characters, and those of hosts of more
    than LONGEST_HOST, are words as they are. Repeated rows and null ids stay; other columns are left out.
    """
    ship(pages.sparkSession)
    rows = ruled(pages, rules)
    bayes = fit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [bayes.score(w.split()) for w in b.column(3).to_pylist()]
            verdict = [v or ("block" if s > 0 else "allow") for v, s in zip(b.column(5).to_pylist(), score, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), b.column(2).cast(pa.string()), b.column(4), pa.array(verdict, pa.string()), b.column(3), pa.array(score, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "words", "score"])

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, words string, score double")
