"""Personal data: fixed patterns, and contexts learned from what they find.

The fixed patterns give the base spans. The words before and after them become lexical patterns; Spark joins patterns and instances over all
documents, scores each pattern by the share of its instances that are believed, each instance by the patterns that point to
it, and repeats. Patterns of high confidence then mark look-alikes in their contexts that the fixed patterns miss: a phone
number without a plus, a card number with a slip of the pen, an address without a dot. What is found in one round lends belief
to other patterns in the next.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import longs, per_batch, plain_text
from tapewright.session import stage

# Fixed values of the contract: kinds in the order in which they are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# What a pattern needs to be trusted, and how far belief spreads.
ROUNDS = 4
LEAST_SEEDS = 4  # different believed instances in its context
LEAST_CONFIDENCE = 0.7
TRUST = 0.9  # belief that a fully confident pattern gives an instance
CONTEXT = 2  # words on a side
SALTS = 16  # tasks among which the rows of one key are dealt


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str):
    """Leftmost addresses, found from their @ backwards: the name before it is as long as it can be."""
    free = 0
    for m in HOST.finditer(text):
        at = begin = m.start()
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at:
            free = m.end()
            yield begin, free


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; offsets in code points, end exclusive."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    # A match begins where a run of digits does, as the one before it ends where one does.
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(_part(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def _part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


# Loose forms. A number may be written with spaces, brackets, points and dashes; an address may spell its @ or lack a point.
NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]{0,2}[0-9](?:[\x20().\-/]{0,3}+[0-9])*+")
PIECE = re.compile(r"[^\x20]+")
AT = re.compile(r"@|\x20?[(\[]at[)\]]\x20?", re.IGNORECASE)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
OTHER_NUMBERS = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}")  # security numbers, dates
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?\"'`()[]{}<>*#%&$|=-"
MASKED = str.maketrans("123456789", "000000000")


def number_kind(form: str) -> int:
    """What a number looks like without being it for certain; -1 for nothing."""
    digits = sum(map(str.isdigit, form))
    if form.count(".") in (2, 3) and digits + form.count(".") == len(form) and digits <= 12:
        return 1
    if 12 <= digits <= 19:
        return 2
    return 3 if 7 <= digits <= 11 and not OTHER_NUMBERS.fullmatch(form) else -1


class Taken:
    """Places that spans hold, to ask whether another one meets them."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a


def look_alikes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what looks like a kind, outside of base spans and of each other.

    A number that has no kind as a whole, or meets a base span, is looked at by its parts between spaces.
    """
    out, taken, free = [], Taken((a, b) for a, _, b in base), 0
    for m in AT.finditer(text):
        begin, host = m.start(), DOMAIN.match(text, m.end())
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        if host and begin < m.start() and not taken.meets(begin, host.end()):
            free = host.end()
            out.append((begin, 0, free))
    taken = Taken([(a, b) for a, _, b in base] + [(a, b) for a, _, b in out])
    for m in NUMBER.finditer(text):
        if m.end() - m.start() < 5 or text[m.end() : m.end() + 1].isalnum():
            continue
        kind = number_kind(m[0])
        if kind >= 0 and not taken.meets(m.start(), m.end()):
            out.append((m.start(), kind, m.end()))
        elif " " in m[0]:
            for part in PIECE.finditer(text, m.start(), m.end()):
                kind = number_kind(part[0])
                if kind >= 0 and not taken.meets(part.start(), part.end()):
                    out.append((part.start(), kind, part.end()))
    return sorted(out)


class Contexts:
    """Lexical patterns around places of one text: words before, words after, and one on each side.

    Words are lower-cased, without marks at their edges, their digits masked; marks alone are no words. The text's ends count as a
    word of their own. Words of any length take part, very long ones by a digest.
    """

    def __init__(self, text: str):
        self.text = text
        self.words = [m.span() for m in WORD.finditer(text) if m[0].strip(EDGES)]
        self.starts, self.ends = [a for a, _ in self.words], [b for _, b in self.words]
        self.known: dict[tuple[int, int], str] = {}

    def word(self, a: int, b: int) -> str:
        if (a, b) not in self.known:
            w = self.text[a:b].strip(EDGES).lower().translate(MASKED)
            self.known[a, b] = w if len(w) <= 64 else f"{w[:16]}~{sha1(w.encode('utf-8', 'surrogatepass')).hexdigest()}"
        return self.known[a, b]

    def before(self, at: int) -> list[str]:
        k = bisect_left(self.starts, at)
        out = []
        while k and len(out) < CONTEXT:
            k -= 1
            a, b = self.words[k]
            if w := self.word(a, min(b, at)):
                out.append(w)
        return [*(out + ["^"])[:CONTEXT]][::-1]

    def after(self, at: int) -> list[str]:
        k = bisect_right(self.ends, at)
        out = []
        while k < len(self.words) and len(out) < CONTEXT:
            a, b = self.words[k]
            if w := self.word(max(a, at), b):
                out.append(w)
            k += 1
        return (out + ["$"])[:CONTEXT]

    def patterns(self, begin: int, end: int) -> list[str]:
        left, right = self.before(begin), self.after(end)
        return [f"{' '.join(left)} _", f"_ {' '.join(right)}", f"{left[-1]} _", f"{left[-1]} _ {right[0]}"]


def instance_of(kind: int, form: str) -> str:
    """The form by which an identifier is known again: digits alone, or lower-cased letters without spaces."""
    if kind >= 2:
        return "".join(c for c in form if c.isdigit())
    return AT.sub("@", form).lower().replace(" ", "")


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and spans: array of (start, kind, end, base, patterns, instance) of every row."""

    def start():
        def work(cols):
            rows = []
            for text in cols["text"]:
                base = base_spans(text)
                every = [(*s, True) for s in base] + [(*s, False) for s in look_alikes(text, base)]
                around = Contexts(text) if every else None
                rows.append([{"start": a, "kind": k, "end": b, "base": x, "patterns": around.patterns(a, b), "instance": instance_of(k, text[a:b])} for a, k, b, x in every])
            kind = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("patterns", pa.list_(pa.string())), ("instance", pa.string())])
            return {"doc_id": longs(cols["doc_id"]), "spans": pa.array(rows, pa.list_(kind))}

        return work

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_text(text_col).alias("text"))
    return per_batch(src, start, "doc_id long, spans array<struct<start: long, kind: int, end: long, base: boolean, patterns: array<string>, instance: string>>")


def spread_join(rows: DataFrame, short: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which a key with many ``rows`` is dealt over SALTS tasks; the short side has one row for each key."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(short.withColumn("_salt", salts), [*keys, "_salt"]).drop("_salt")


def live_edges(edges: DataFrame, least_seeds: float = LEAST_SEEDS) -> DataFrame:
    """Edges of the patterns that may come to be trusted and to tell something: most patterns are met once and never can.

    Support is at most the number of different instances, and a pattern around base instances alone has none to find.
    """
    sizes = edges.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("base")).alias("_open"))
    return spread_join(edges, sizes.filter((F.col("_n") >= least_seeds) & (F.col("_open") > 0)).drop("_n", "_open"), ["kind", "pattern"])


def trusted_patterns(edges: DataFrame, *, rounds: int = ROUNDS, least_seeds: float = LEAST_SEEDS, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """kind, pattern, confidence of the patterns to trust, from edges: kind, pattern, instance, n, base.

    A seed is believed throughout. Confidence is the share of a pattern's occurrences whose instance is believed, support the sum of
    belief over its different instances, so that later rounds trust patterns around what earlier ones have found. Belief in any
    other instance is one minus the chance that all trusted patterns pointing to it are wrong.
    """
    edges = edges.withColumn("base", F.col("base").cast("double"))
    belief = stage(edges.groupBy("kind", "instance").agg(F.max("base").alias("belief")), "pii-belief")
    patterns, found = None, -1
    for turn in range(rounds):
        weighed = spread_join(edges, belief, ["kind", "instance"]).groupBy("kind", "pattern").agg(
            (F.sum(F.col("n") * F.col("belief")) / F.sum("n")).alias("confidence"), F.sum("belief").alias("support")
        )
        # Sums of doubles differ in their last places with the order of rows.
        enough = (F.round("support", 6) >= least_seeds) & (F.round("confidence", 6) >= least_confidence)
        patterns = stage(weighed.filter(enough).select("kind", "pattern", "confidence"), "pii-patterns")
        before, found = found, patterns.count()
        if turn == rounds - 1 or found in (0, before):
            break
        told = spread_join(edges, patterns, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log1p(-TRUST * F.col("confidence"))))).alias("told"))
        belief = stage(belief.join(told, ["kind", "instance"], "left").select("kind", "instance", F.greatest("belief", F.coalesce("told", F.lit(0.0))).alias("belief")), "pii-belief")
    return patterns


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **trust) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (spans as text), spans and found (array of kind, start, end, base) of every row.

    Counts are of base spans. Null and empty texts have none. Spans are kind:start:end by start and kind. Rows may repeat and ids may
    be null, as rows are told apart by their place; other columns are not read, so their names cannot clash. Every identifier in a
    trusted pattern is marked, however many patterns tie for it.
    """
    rows = stage(occurrences(docs, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id()), "pii-rows")
    each = rows.select("row_id", F.inline("spans"))
    known = each.select("row_id", "start", "kind", "end", "base", "instance", F.explode("patterns").alias("pattern"))
    edges = stage(known.groupBy("kind", "pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("base").alias("base")), "pii-edges")
    edges = stage(live_edges(edges, trust.get("least_seeds", LEAST_SEEDS)), "pii-live-edges")
    patterns = trusted_patterns(edges, **trust)
    more = spread_join(known.filter("not base"), patterns, ["kind", "pattern"]).groupBy("row_id").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    plain = F.transform(F.filter("spans", lambda s: s["base"]), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    out = rows.join(more, "row_id", "left").withColumn("own", plain)
    out = out.withColumn("all", F.sort_array(F.when(F.col("more").isNull(), F.col("own")).otherwise(F.concat("own", "more"))))
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("own", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, text("own").alias("base"), text("all").alias("spans"))
