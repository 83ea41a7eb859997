"""Citations and addresses: packs of shapes, the keys that citations stand for, the files that may hold them, and what
an address beside a quotation says about its verdict.

A pack is a JSON file: shapes (a regex, and what of it is the address), aliases from one system of numbers to another, and
rules by which a file's name or text shows that it holds an address. Packs are read on the driver and sent whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestia.functions import text as T
from attestia.plans import verdicts
from attestia.store import keep

FOLDER = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "packs")
#: Characters of a file's head that rules may ask, rings around a quotation, and files that a repair looks into.
HEAD, NEAR, FAR, TRIES, LEAST = 8000, 140, 400, 10, 60
#: Distinct keys that are sent to the corpus at once.
BLOCK = 10_000


def filled(pattern: str, key: tuple[str, ...]) -> str:
    """A rule's pattern with {g1}, {g2} ... as the key's parts, put in as they are."""
    for k, part in enumerate(key[1:], 1):
        pattern = pattern.replace(f"{{g{k}}}", part)
    return pattern


@lru_cache(maxsize=4096)
def compiled(pattern: str) -> re.Pattern | None:
    try:
        return re.compile(pattern, re.I)
    except re.error:
        return None


@dataclass
class Source:
    """A file as rules see it: its name in two forms, its text, and the head of it."""

    name: str
    body: str

    @cached_property
    def flat(self) -> str:
        """Without hyphens, underscores and spaces: names of downloads agree in little else."""
        return re.sub(r"[-_ ]", "", os.path.basename(self.name).lower())

    @cached_property
    def words(self) -> str:
        return _words(os.path.basename(self.name).lower())

    @cached_property
    def low(self) -> str:
        return self.body.lower()

    def part(self, where: str) -> str:
        return {"body": self.body, "body_head": self.low[:HEAD]}.get(where, self.flat)

    def names(self, needle: str) -> bool:
        """Whether the name holds a needle: as words of it; else flattened, where a number at the needle's end must be a
        number of its own, without a letter behind it that makes it another part."""
        spaced, joined = _words(needle), re.sub(r"[-_ .]", "", needle)
        if spaced and re.search(rf"(?<![0-9a-zа-яё]){re.escape(spaced)}(?![0-9a-zа-яё])", self.words):
            return True
        number = re.search(r"\d+[a-z]?$", joined)
        if not number:
            return joined in self.flat
        if number[0].isdigit() and re.search(rf"(?<![0-9]){number[0]}[a-z](?![0-9a-zа-яё])", self.words):
            return False
        return bool(re.search(rf"(?<![0-9]){re.escape(joined)}(?![0-9])(?![a-z](?![a-z]))", self.flat))


def _words(s: str) -> str:
    return re.sub(r"[^0-9a-zа-яё]+", " ", s).strip()


@dataclass
class Rule:
    """One way in which a file shows that it holds an address; all that it asks must hold."""

    where: str = "filename_flat"
    all: list[str] = field(default_factory=list)
    any: list[str] = field(default_factory=list)
    regex_all: list[dict] = field(default_factory=list)
    reject_if_head_names: list[dict] = field(default_factory=list)

    def holds(self, source: Source, key: tuple[str, ...]) -> bool:
        part = source.part(self.where)

        def has(needle: str) -> bool:
            wanted = filled(needle, key).lower()
            return source.names(wanted) if self.where == "filename_flat" else wanted in part.lower()

        def counts(probe: dict) -> bool:
            p = compiled(filled(probe["pattern"], key))
            return p is not None and sum(1 for _ in p.finditer(part)) >= int(probe.get("min_count", 1))

        return not any(self._denied(source, key, x) for x in self.reject_if_head_names) and all(map(has, self.all)) and (not self.any or any(map(has, self.any))) and all(map(counts, self.regex_all))

    @staticmethod
    def _denied(source: Source, key: tuple[str, ...], ask: dict) -> bool:
        """The file's head names parts, and ours is none of them."""
        named = {m[1].lower() for m in re.finditer(filled(ask["scan"], key), source.low[:HEAD], re.I)}
        return bool(named) and filled(ask["expect"], key).lower() not in named


class Packs:
    """Several packs as one."""

    def __init__(self, specs: list[dict]):
        self.specs = specs
        self.ids = [s["id"] for s in specs]
        self.shapes = [(re.compile(x["regex"], 0 if x.get("case_sensitive") else re.I), x.get("address"), spec.get("aliases", {})) for spec in specs for x in spec.get("shapes", [])]
        self.kinds: dict[str, list[dict]] = {}
        for spec in specs:
            own: set[str] = set()
            for x in spec.get("shapes", []):
                if (a := x.get("address")) and a["kind"] not in own:
                    own.add(a["kind"])
                    self.kinds.setdefault(a["kind"], []).append(a)
        self.hints = [re.compile(h, re.I) for s in specs if (h := s.get("primary_hint"))]
        self.domains = list(dict.fromkeys(str(d).lower().strip().lstrip(".") for s in specs for d in s.get("official_domains") or [] if d))

    def __reduce__(self):
        return Packs, (self.specs,)

    def positions(self, text: str) -> list[tuple[str, int]]:
        """(citation with single spaces, where it begins), in order of place."""
        return sorted(((" ".join(m[0].split()), m.start()) for p, _, _ in self.shapes for m in p.finditer(text or "")), key=lambda x: x[1])

    def find(self, text: str) -> list[str]:
        return list(dict.fromkeys(c for c, _ in self.positions(text)))

    def keys(self, cites: list[str]) -> list[tuple[str, ...]]:
        """The distinct addresses of citations, sorted: kind and parts, in lower case, under their aliases."""
        found = set()
        for cite in cites or []:
            for p, address, aliases in self.shapes:
                for m in p.finditer(cite) if address else ():
                    parts = [m[g] for g in address["groups"]]
                    if None not in parts:
                        found.add(self._alias(address["kind"], [x.strip().lower() for x in parts], aliases))
        return sorted(found)

    @staticmethod
    def _alias(kind: str, parts: list[str], aliases: dict) -> tuple[str, ...]:
        if not (to := aliases.get(kind)):
            return (kind, *parts)
        at = int(to.get("on", 0))
        member = to["map"].get(parts[at]) if "map" in to else parts[at]
        if member is None:  # a known system, but an unknown member of it
            return (kind, *parts)
        return (to["to_kind"], *to.get("to_prefix", []), member, *parts[:at], *parts[at + 1 :])

    def label(self, key: tuple[str, ...]) -> str:
        for a in self.kinds.get(key[0], []):
            if a.get("label", "").count("%s") == len(key) - 1:
                return a["label"] % tuple(key[1:])
        return " ".join(key)

    def holds(self, key: tuple[str, ...], source: Source) -> bool:
        return any(Rule(**rule).holds(source, key) for a in self.kinds.get(key[0], []) for rule in a.get("file_match", []))

    def is_primary(self, cite: str) -> bool:
        """Whether a citation promises a document that ought to be in a corpus of primary sources."""
        return any(h.search(cite) for h in self.hints)


def available() -> list[str]:
    return sorted(f[:-5] for f in os.listdir(FOLDER) if f.endswith(".json"))


def load(names: list[str]) -> Packs:
    """Packs by name, or by the path of a JSON file; an unknown one is an error that lists those there are."""
    specs = []
    for name in names:
        path = name if name.endswith(".json") else os.path.join(FOLDER, name + ".json")
        if not os.path.exists(path):
            raise ValueError(f"no citation pack {name}; there are {', '.join(available())}")
        with open(path, encoding="utf-8") as f:
            specs.append(json.load(f))
    return Packs(specs)


def window(body: str, quote: str, packs: Packs, near: int = NEAR, far: int = FAR) -> tuple[list[str], list[str]]:
    """(citations beside a quotation and not within it, all in the wider ring), from its first place in a draft."""
    at = body.find(quote[:60])
    if at < 0:
        return [], []
    low, end = max(0, at - far), at + len(quote)
    found = [(c, low + p) for c, p in packs.positions(body[low : end + far])]
    beside = [c for c, p in found if at - near <= p < end + near and not at <= p < end]
    return list(dict.fromkeys(beside)), list(dict.fromkeys(c for c, _ in found))


RINGS = "array<struct<quote:string,near:array<string>,far:array<string>,legal:array<string>,far_legal:array<string>>>"


def rings(packs: Packs):
    """A column function of (draft, its quotations): an array of each quotation with its rings, and which citations in them
    are primary."""

    @F.pandas_udf(RINGS)
    def around(bodies: pd.Series, quotes: pd.Series) -> pd.Series:
        def one(body: str, quote: str) -> dict:
            near, far = window(body, quote, packs)
            return {"quote": quote, "near": near, "far": far, "legal": [c for c in near if packs.is_primary(c)], "far_legal": [c for c in far if packs.is_primary(c)]}

        return pd.Series([[one(b or "", q) for q in qs] for b, qs in zip(bodies, quotes)], dtype=object)

    return around


def cite_positions(packs: Packs):
    """A column function: array of (cite, pos) of a text."""

    @F.pandas_udf("array<struct<cite:string,pos:int>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"cite": c, "pos": p} for c, p in packs.positions(t or "")])

    return found


def cite_keys(packs: Packs):
    """A column function: array of keys (arrays of strings) of an array of citations."""

    @F.pandas_udf("array<array<string>>")
    def found(cites: pd.Series) -> pd.Series:
        return cites.map(lambda cs: [list(k) for k in packs.keys(list(cs) if cs is not None else [])])

    return found


def key_label(packs: Packs):
    """A column function: the label of a key."""

    @F.pandas_udf("string")
    def told(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: packs.label(tuple(k)))

    return told


def key_files(keys: DataFrame, corpus: DataFrame, packs: Packs, block: int = BLOCK) -> DataFrame:
    """(key, doc_ord, path): the documents that may hold each distinct key. corpus: (doc_ord, path, t).

    Keys are sent in blocks, each once through the corpus; a task holds one document.
    """
    spark, schema = corpus.sparkSession, "key array<string>, doc_ord long, path string"
    frames, held = [], []

    def scan(chunk: list[tuple[str, ...]]) -> DataFrame:
        sent = spark.sparkContext.broadcast((packs, chunk))

        def run(frames_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            packs_, keys_ = sent.value
            for frame in frames_:
                rows = [(list(k), d, p) for d, p, t in frame.itertuples(index=False) for source in [Source(p, t)] for k in keys_ if packs_.holds(k, source)]
                yield pd.DataFrame(rows, columns=["key", "doc_ord", "path"])

        return corpus.select("doc_ord", "path", "t").mapInPandas(run, schema)

    for row in keys.select("key").distinct().toLocalIterator():
        held.append(tuple(row["key"]))
        if len(held) >= block:
            frames.append(scan(held))
            held = []
    if held:
        frames.append(scan(held))
    out = frames[0] if frames else spark.createDataFrame([], schema)
    for more in frames[1:]:
        out = out.unionAll(more)
    return keep(out, "key-files")


ADDRESS = "status string, matched string, keys array<string>, expected array<string>"


def address(rows: DataFrame, files: DataFrame, packs: Packs) -> DataFrame:
    """(k, status, matched, keys, expected, expected_ord) of rows (k, doc_ord, cites): what the address beside a quotation
    says about the document that it was found in. files: ``key_files``.

    status: NO_NEARBY_CITATION without a key, ADDRESS_NOT_IN_CORPUS where no document may hold any, MATCHED, MISMATCH.
    expected names the first TRIES documents, by path, that may hold a known key.
    """
    keyed = rows.withColumn("__keys", cite_keys(packs)("cites"))
    flat = keyed.select("k", "doc_ord", F.explode("__keys").alias("key")).withColumn("label", key_label(packs)("key"))
    by_path = F.sort_array(F.collect_set(F.struct("path", "doc_ord")))
    # of a key that a third of the corpus may hold, only its first documents by path are told
    first = files.withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy("path"))).where(F.col("__r") <= TRIES).groupBy("key").agg(by_path.alias("paths"))
    hit = files.select(F.col("key").alias("__key"), F.col("doc_ord").alias("__doc")).distinct()
    asked = flat.join(first, "key", "left").join(hit, (F.col("key") == F.col("__key")) & (F.col("doc_ord") == F.col("__doc")), "left")
    known = F.col("paths").isNotNull()
    told = asked.groupBy("k").agg(
        F.sort_array(F.collect_set("label")).alias("all"), F.sort_array(F.collect_set(F.when(known, F.col("label")))).alias("known"),
        F.min(F.when(F.col("__doc").isNotNull(), F.col("label"))).alias("matched"), F.flatten(F.collect_list("paths")).alias("paths"),
    )
    best = F.slice(F.array_sort(F.array_distinct("paths")), 1, TRIES)
    status = F.when(F.col("all").isNull(), "NO_NEARBY_CITATION").when(F.size("known") == 0, "ADDRESS_NOT_IN_CORPUS").when(F.col("matched").isNotNull(), "MATCHED").otherwise("MISMATCH")
    none = F.array().cast("array<string>")
    out = rows.select("k").join(told, "k", "left").withColumn("status", status)
    mismatch = F.col("status") == "MISMATCH"
    return out.select(
        "k", "status", "matched", F.coalesce(F.when(mismatch, F.col("known")).otherwise(F.col("all")), none).alias("keys"),
        F.when(mismatch, F.transform(best, lambda x: x["path"])).otherwise(none).alias("expected"),
        F.when(mismatch, F.transform(best, lambda x: x["doc_ord"])).otherwise(F.array().cast("array<bigint>")).alias("expected_ord"),
    )


def repairs(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """(k, repaired, repaired_path): the first of the expected documents that holds the quotation after all, under any
    projection. rows: (k, n, expected_ord); quotations under 60 characters are never repaired, as they may be there by chance."""
    long_ = rows.where(F.char_length("n") >= LEAST).select("k", "n", F.explode("expected_ord").alias("doc_ord"))
    here = long_.join(corpus.select("doc_ord", "path", "t", "a", "h"), "doc_ord")
    n = F.col("n")
    holds = F.contains("t", n) | F.contains("a", T.alnum(n)) | F.contains("h", T.dehyph(n))
    return here.where(holds).groupBy("k").agg(F.min(F.struct("path", "doc_ord")).alias("x")).select("k", F.col("x.doc_ord").alias("repaired"), F.col("x.path").alias("repaired_path"))


def fold(judged: DataFrame, corpus: DataFrame, packs: Packs) -> DataFrame:
    """Verdicts with their addresses: (k, verdict, class, doc_ord, detail, address). judged: (k, n, cites, verdict, doc_ord,
    detail); cites are the primary ones beside the quotation. corpus: (doc_ord, path, t, a, h).

    A quotation that is nowhere, with an address that no document may hold, was not checked: NO_SOURCE_ON_DISK. One found
    where its address does not point is repaired if a document there holds it; else a clean verdict is FOUND_ELSEWHERE.
    address is null where there was nothing to ask.
    """
    files = key_files(judged.select(F.explode(cite_keys(packs)("cites")).alias("key")), corpus, packs)
    told = keep(address(judged.select("k", "doc_ord", "cites"), files, packs), "addresses")
    fixed = repairs(judged.select("k", "n", "doc_ord").join(told.where("status = 'MISMATCH'"), "k").where("doc_ord IS NOT NULL").select("k", "n", "expected_ord"), corpus)
    rows = judged.join(told, "k").join(fixed, "k", "left").join(corpus.select("doc_ord", F.col("path").alias("__path")), "doc_ord", "left")
    names = F.array_join("keys", "; ")
    base = lambda c: F.regexp_extract(c, r"([^/\\]*)$", 1)
    missing = F.col("doc_ord").isNull() & (F.col("verdict") == "NOT_FOUND") & (F.size("cites") > 0)
    mismatch = F.col("doc_ord").isNotNull() & (F.col("status") == "MISMATCH")
    mended = mismatch & F.col("repaired").isNotNull()
    clean = F.col("verdict").isin(*verdicts.ADDRESS_CLEAN)
    elsewhere = mismatch & ~mended & clean
    unread = missing & (F.col("status") == "ADDRESS_NOT_IN_CORPUS")
    also = F.when(F.col("detail") != "", F.concat(F.lit("; "), F.col("detail"))).otherwise(F.lit(""))
    detail = (
        F.when(unread, F.concat(F.lit("not checked: no document holds "), names))
        .when(missing & F.col("status").isin("MISMATCH", "MATCHED"), F.concat(F.lit("the cited source is there ("), names, F.lit(") and does not have these words"), also))
        .when(mended & (F.col("verdict") != "VERIFIED"), F.concat(F.lit("right at the cited address in "), base(F.col("repaired_path")), F.lit("; was "), F.col("verdict"), F.lit(" in "), base(F.col("__path"))))
        .when(elsewhere, F.concat(F.lit("found in "), base(F.col("__path")), F.lit(", but the address beside it ("), names, F.lit(") points at "), F.array_join(F.transform(F.slice("expected", 1, 3), base), ", "), also))
        .when(mismatch & ~mended, F.concat(F.lit("cited "), names, F.lit(", found in "), base(F.col("__path")), also))
        .otherwise(F.col("detail"))
    )
    verdict = F.when(unread, "NO_SOURCE_ON_DISK").when(mended, "VERIFIED").when(elsewhere, "FOUND_ELSEWHERE").otherwise(F.col("verdict"))
    asked = F.col("doc_ord").isNotNull() | (missing & (F.col("status") != "NO_NEARBY_CITATION"))
    none = F.array().cast("array<string>")
    where = F.struct(
        F.when(mended, "MATCHED").otherwise(F.col("status")).alias("status"), F.when(mended, "after binding").otherwise(F.col("matched")).alias("matched"), "keys",
        F.when(mended, none).otherwise(F.col("expected")).alias("expected"),
    )
    return rows.select("k", verdict.alias("verdict"), verdicts.class_of(verdict).alias("class"), F.when(mended, F.col("repaired")).otherwise(F.col("doc_ord")).alias("doc_ord"), detail.alias("detail"), F.when(asked, where).alias("address"))
