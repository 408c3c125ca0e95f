"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so a question whose figures
or names were changed keeps its template. Names are told by their capitals, so
there is a second form beside this one, in which names are words and case does
not count: a copy in lower or upper case has all windows of that form. Windows
of five template words are hash-joined to those of the benchmark items, form by
form. What stands in the slots of matched windows must agree: within a document
and item, one value of the item stands for one value of the document and the
other way round; windows that speak against this are not counted.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import shared

#: Words that name a unit.
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degrees mph kmh".split())
TRIM = re.compile(r"^[^\w$€£%]+|[^\w$€£%]+$")
NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*%?")
FILTER_BITS = 24


@dataclass(frozen=True)
class Params:
    words: int = 5
    share: float = 0.8  # of an item's windows that a document must have


class Templates(dict):
    """word -> place of its template word in hashes and kinds, kept for the words met last.

    Each template word has two forms, with typed names and without regard to
    case: a 64-bit hash (0: nothing but signs) and a slot type or ''.
    """

    def __init__(self, kept: int = 300_000):
        super().__init__()
        self.kept, self.hashes, self.kinds = kept, np.zeros((2, 1024), np.uint64), []

    def __missing__(self, word: str) -> int:
        core = TRIM.sub("", word)
        kind = "number" if NUMBER.fullmatch(core) else "unit" if core.lower() in UNITS else ""
        named = kind or ("name" if core[:1].isupper() and core[1:].islower() else "")
        self[word] = at = len(self.kinds)
        if at == self.hashes.shape[1]:
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)], axis=1)
        forms = (f"<{named}>" if named else core.lower(), f"<{kind}>" if kind else core.casefold())
        self.hashes[:, at] = [xxhash.xxh3_64_intdigest(x) if core else 0 for x in forms]
        self.kinds.append((named, kind))
        return at

    def places(self, words: list[str]) -> np.ndarray:
        """The places of a text's words, good until the next text."""
        if len(self) >= self.kept:
            self.clear()
            self.kinds.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def template_words(text: str, templates: Templates) -> tuple[np.ndarray, list[str]]:
    """The words of a text and their hashes, a row for each form; words of nothing but signs are left out."""
    words = text.split()
    at = templates.places(words)  # before hashes is read, as new words may lengthen it
    h = templates.hashes[:, at]
    if not h.all():
        words = [w for w, x in zip(words, h[0], strict=True) if x]
        h = h[:, h[0] != 0]
    return h, words


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Window hashes of a text's template words, a row for each form; none where the text is shorter than a window."""
    n = max(0, h.shape[1] - size + 1)
    out = np.empty((2, n), np.uint64)
    out[0], out[1] = size, size + 256
    for i in range(size if n else 0):
        out = (out ^ h[:, i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def slots(words: list[str], at: int, size: int, templates: Templates, form: int, places: bool = False) -> str:
    """The slots of a window: type, value and, if asked for, place of each, apart by control characters."""
    return "\x1e".join(f"{kind}\x1f{TRIM.sub('', w)}" + f"\x1f{at + i}" * places for i, w in enumerate(words[at : at + size]) if (kind := templates.kinds[templates[w]][form]))


def item_windows(items: DataFrame, p: Params) -> DataFrame:
    """(item_id, form, h, at, slots, n, size, bare): the windows of each item, n of them in each form. Null and empty items have none.

    An item shorter than a window is one window of its own size. bare: the slots
    of such an item where it is nothing but slots, else null.
    """

    def run(batches):
        templates = Templates()
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, words = template_words(text or "", templates)
                size = min(p.words, len(words))
                h = windows(h, size) if words else h
                for form in (0, 1):
                    bare = slots(words, 0, size, templates, form) if size < p.words and all(templates.kinds[templates[w]][form] for w in words) else None
                    out += [(item, form, x, k, slots(words, k, size, templates, form, True), h.shape[1], size, bare) for k, x in enumerate(h[form].view(np.int64).tolist())]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 8, kinds, strict=True)], ["item_id", "form", "h", "at", "slots", "n", "size", "bare"])

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_id long, form int, h long, at int, slots string, n int, size int, bare string")


def _bitmap(wanted: DataFrame) -> np.ndarray:
    """A bitmap of the windows' hashes, of a fixed size however many windows there are."""

    def run(batches):
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()])], ["bits"])

    total = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in wanted.select("h").distinct().coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(total).astype(bool)


def document_windows(docs: DataFrame, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """(doc_id, h, at, slots) of the windows of these sizes that the bitmap lets pass; the join decides."""
    shared_bits = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def run(batches):
        templates, bits = Templates(), np.unpackbits(shared_bits.value).astype(bool)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole, words = template_words(text.as_py() or "", templates)
                for size in sizes:
                    h = windows(whole, size)
                    hit = np.argwhere(bits[h >> np.uint64(64 - FILTER_BITS)]).tolist()
                    out += [(doc, int(h[form, k].view(np.int64)), k, slots(words, k, size, templates, form)) for form, k in hit]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 4, kinds, strict=True)], ["doc_id", "h", "at", "slots"])

    return shared.in_small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, h long, at long, slots string")


def slot_pairs(item: str, doc: str) -> list[tuple[tuple[str, str], str, str]]:
    """((type, value of the item), value of the document, place in the item) of a window's slots. A unit may be written in several ways."""
    both = zip(item.split("\x1e"), doc.split("\x1e"), strict=False) if item else ()
    found = [(*a.split("\x1f"), b.split("\x1f")[1]) for a, b in both]
    return [((kind, x), y, place) for kind, x, place, y in found if kind != "unit"]


def agreeing(taken: list[tuple[str, str]]) -> tuple[int, int]:
    """How many windows agree in their slots, and how many values differ in these.

    Slot values must map one to one, type by type. Where they don't, the windows
    that speak against the mapping are left out: of values in conflict, those
    stand that more places of the item show, then those that are equal; where
    neither decides, none stands. Windows equal in all slots always agree.
    """
    pairs = [slot_pairs(item, doc) for item, doc in taken]
    shown: dict[tuple, set[str]] = {}
    for x, y, place in (q for w in pairs for q in w):
        shown.setdefault((x, y), set()).add(place)
    rank = {(x, y): (len(places), x[1] == y) for (x, y), places in shown.items()}
    stand, used = set(), set()
    for _, group in itertools.groupby(sorted(rank, key=rank.get, reverse=True), rank.get):
        sides = {(x, y): ((x,), (x[0], y)) for x, y in group if not {(x,), (x[0], y)} & used}
        count = Counter(side for both in sides.values() for side in both)
        stand |= {q for q, both in sides.items() if count[both[0]] == count[both[1]] == 1}
        used |= count.keys()
    voted = [w for w in pairs if all((x, y) in stand for x, y, _ in w)]
    changed = {x for w in voted for x, y, _ in w if x[1] != y}
    equal = sum(all(x[1] == y for x, y, _ in w) for w in pairs)
    matched, minus = max((len(voted), -len(changed)), (equal, 0))
    return matched, -minus


def contaminated(docs: DataFrame, items: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, item_id, windows, matched, changed_slots) of documents that hold an item.

    A document holds an item if at least `share` of the item's windows of one
    form stand in it in one alignment each, with consistent slots; windows whose
    slots contradict the others don't count. The form with more windows is
    reported. An item of fewer words than a window is sought as one window of its
    size; if it is nothing but slots, their values must be equal, as any number
    would do for another else. changed_slots counts its values that differ (0: a plain copy, of
    whatever case). Null and empty texts match nothing; rows that repeat a doc_id
    are one document; a null doc_id is reported as null. Empty tables give no
    rows. Other columns are ignored.
    """
    wanted = shared.staged(item_windows(items, p), "item-windows")
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())  # p.words of them at most
    found = document_windows(docs, _bitmap(wanted), sizes)
    item = wanted.select("item_id", "form", "h", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), "n", "bare")
    # windows are gathered by document, item, form and shift, so a passage that many documents share is no large group
    met = found.join(item, "h").filter(F.coalesce(F.lower("bare") == F.lower("slots"), F.lit(True))).withColumn("shift", F.col("at") - F.col("item_at")).groupBy("doc_id", "item_id", "n", "form", "shift").agg(F.collect_set(F.struct("item_at", "item_slots", "slots")).alias("w"))
    # a line or word put in between shifts the rest: the shifts of one occurrence are taken together, largest first
    met_of = lambda form: F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("form") == form, F.transform("w", lambda x: x["item_at"]))))))
    per = met.groupBy("doc_id", "item_id", "n").agg(F.array_sort(F.collect_list(F.struct((-F.size("w")).alias("k"), "shift", "form", "w"))).alias("shifts"), F.greatest(met_of(0), met_of(1)).alias("all"))
    per = per.filter(F.col("all") >= F.ceil(F.col("n") * F.lit(p.share))).drop("all")

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, item_id, n, shifts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best = (0, 0)
                lines = [sorted((s["shift"], i) for i, s in enumerate(shifts) if s["form"] == form) for form in (0, 1)]
                for lead in shifts:
                    line, at = lines[lead["form"]], lead["shift"]
                    near = [shifts[i] for i in sorted(i for _, i in line[bisect.bisect_left(line, (at - n,)) : bisect.bisect_left(line, (at + n + 1,))])]
                    taken: dict[int, tuple[str, str]] = {}
                    for s in [lead, *near]:
                        for w in s["w"]:
                            taken.setdefault(w["item_at"], (w["item_slots"], w["slots"]))
                    tries = [list(taken.values())]
                    if len(near) > 1:  # also without the parts at other shifts
                        tries.append([(w["item_slots"], w["slots"]) for w in lead["w"]])
                    for matched, changed in map(agreeing, tries):
                        if (matched, -changed) > (best[0], -best[1]):
                            best = (matched, changed)
                    if best[0] == n:
                        break
                if best[0] >= p.share * n:
                    out.append((doc, item_id, n, best[0], best[1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out, strict=True)) or [[]] * 5], ["doc_id", "item_id", "windows", "matched", "changed_slots"])

    return per.mapInArrow(run, "doc_id long, item_id long, windows long, matched long, changed_slots long")


def clean(docs: DataFrame, items: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs, all columns, that hold no item of the benchmark. Rows without a doc_id stay."""
    bad = contaminated(docs, items, p).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["_bad"], "left_anti")
