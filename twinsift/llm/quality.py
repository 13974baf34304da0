"""Per-document text quality: statistics, and an ordered rule list learned from labelled documents.

The statistics are exact counts over whole texts.  The rule list is induced by
incremental reduced-error pruning: a rule is grown condition by condition on one
part of the labelled sample, shortened on the other, kept if it is right more often
than wrong there, and what it covers is set aside for the next rule.  Its
thresholds become a SQL CASE expression, which Spark evaluates natively.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm import bytescan

#: Most documents a rule list is learned from, chosen by hash of the id.
SAMPLE_DOCUMENTS = 20_000

COUNTS = ("n_words", "n_word_chars", "n_symbols", "n_lines", "n_stop_lines", "n_common")


def word_keys(words: list[str], lanes: int) -> np.ndarray:
    """Words as fixed-width rows of 64-bit lanes, zero padded."""
    return np.frombuffer(b"".join(w.encode().ljust(8 * lanes, b"\0") for w in words), "<u8").reshape(len(words), lanes)


def common_counts(data: np.ndarray, begin: np.ndarray, end: np.ndarray, words: list[str]) -> np.ndarray:
    """Mask of the words (byte ranges) that are in ``words`` once stripped of all but ASCII letters at both ends and lower-cased."""
    hit = np.zeros(len(begin), bool)
    usable = [w for w in words if w and w.isascii() and w == w.lower() and w[0].isalpha() and w[-1].isalpha()]
    letters = np.nonzero(bytescan.LETTER[data])[0]
    if not usable or not len(letters):
        return hit
    longest = max(map(len, usable))
    lanes = -(-longest // 8)
    at = np.searchsorted(letters, begin)
    first = letters[np.minimum(at, len(letters) - 1)]
    last = letters[np.maximum(np.searchsorted(letters, end) - 1, 0)]
    size = last - first + 1
    few = np.nonzero((at < len(letters)) & (first < end) & (last >= begin) & (size <= longest))[0]
    first, size = first[few], size[few]
    folded = bytescan.LOWER[data]
    rows = np.zeros((len(few), 8 * lanes), np.uint8)
    for k in range(longest):
        there = np.nonzero(size > k)[0]
        rows[there, k] = folded[first[there] + k]
    rows = rows.view("<u8")
    table = word_keys(usable, lanes)
    if lanes == 1:
        hit[few] = np.isin(rows[:, 0], table[:, 0])
        return hit
    ranks, column = {bytes(r): i for i, r in enumerate(table.view(np.uint8).reshape(len(table), -1))}, rows
    near = np.isin(column[:, 0], table[:, 0])
    exact = np.zeros(len(few), bool)
    exact[near] = [bytes(r) in ranks for r in column[near].view(np.uint8)]
    hit[few] = exact
    return hit


KELVIN = "K"  # the one letter beyond ASCII whose lower case is an ASCII letter


def kelvin_words(text: str, words: set[str]) -> int:
    """Common words of a text with a Kelvin sign, word by word."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    count = 0
    for word in text.translate({9: " ", 10: " ", 13: " "}).split(" "):
        spots = [i for i, c in enumerate(word) if c in letters]
        count += bool(spots) and word[spots[0] : spots[-1] + 1].lower() in words
    return count


def text_counts(texts: pa.Array, words: list[str]) -> dict[str, np.ndarray]:
    """The COUNTS of every text."""
    out = {name: np.zeros(len(texts), np.int64) for name in COUNTS}
    known = set(words)
    for a, b, data, offsets in bytescan.chunks(texts):
        if not len(data):
            continue
        first = bytescan.starts_of(offsets, len(data))
        solid = ~bytescan.BLANK[data]
        begin, end = bytescan.runs(solid, first)
        owner = bytescan.text_of(begin, offsets)
        out["n_words"][a:b] = np.bincount(owner, minlength=b - a)
        out["n_word_chars"][a:b] = bytescan.per_text(solid & ((data & 0xC0) != 0x80), offsets)
        out["n_symbols"][a:b] = bytescan.per_text(bytescan.PUNCTUATION[data], offsets)
        # the last word of a line is one whose successor begins after a line feed, or in another text
        line = np.cumsum((data == 10) | first)[begin]
        closing = np.r_[line[1:] != line[:-1], True] if len(line) else np.zeros(0, bool)
        out["n_lines"][a:b] = np.bincount(owner[closing], minlength=b - a)
        out["n_stop_lines"][a:b] = np.bincount(owner[closing & bytescan.STOP[data[end - 1]]] if len(end) else [], minlength=b - a)
        out["n_common"][a:b] = np.bincount(owner[common_counts(data, begin, end, words)], minlength=b - a)
    sign = np.nonzero(np.asarray(pa.compute.match_substring(texts, KELVIN).fill_null(False)))[0]
    for i in sign:
        out["n_common"][i] = kelvin_words(texts[int(i)].as_py(), known)
    return out


def text_statistics(df: DataFrame, common: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_words: int = 100_000) -> DataFrame:
    """(id, n_words, n_word_chars, n_symbols, n_lines, n_stop_lines, n_common and the shares made of them) per document.

    Words are runs of anything but space, tab, CR and LF; lines are split at LF and
    count if not blank; symbols are ASCII punctuation; a word is common if it is in
    ``common`` once stripped of all but ASCII letters at both ends and lower-cased.
    A null text counts as empty: all counts 0, all shares null.  One row per row of
    ``df``; ``common`` is read to the driver and may hold ``most_words`` words.
    """
    rows = common.select("word").where("word is not null").distinct().limit(most_words + 1).collect()
    if len(rows) > most_words:
        raise ValueError(f"the list of common words has more than {most_words} entries")
    words = sorted(r[0] for r in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            counts = text_counts(batch.column(1), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[c]) for c in COUNTS]], names=["doc_id", *COUNTS])

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = narrow.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))
    return counted.select(
        "*",
        F.try_divide("n_word_chars", "n_words").alias("mean_word_length"),
        F.try_divide("n_symbols", "n_word_chars").alias("symbol_share"),
        F.try_divide("n_stop_lines", "n_lines").alias("stop_line_share"),
        F.try_divide("n_common", "n_words").alias("common_share"),
    )


def prose_policy() -> Column:
    """The documented definition of natural prose, in integers."""
    return (
        (F.col("n_words") >= 30)
        & (F.col("n_word_chars") >= 3 * F.col("n_words"))
        & (F.col("n_word_chars") <= 10 * F.col("n_words"))
        & (10 * F.col("n_symbols") <= F.col("n_word_chars"))
        & (2 * F.col("n_stop_lines") >= F.col("n_lines"))
        & (5 * F.col("n_common") >= F.col("n_words"))
    )


FEATURES = ("n_words", "mean_word_length", "symbol_share", "stop_line_share", "common_share")


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str  # ">=" or "<="
    value: float

    def sql(self) -> str:
        return f"{self.feature} {self.op} {self.value!r}D"

    def holds(self, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        column = x[:, names.index(self.feature)]
        return column >= self.value if self.op == ">=" else column <= self.value


def roundest(low: float, high: float) -> float:
    """The number of fewest decimals in [low, high]."""
    for digits in range(-3, 17):
        step = 10.0**-digits
        value = round(np.ceil(low / step - 1e-12) * step, max(digits, 0))
        if low <= value <= high:
            return float(value)
    return float(high)


def grow_rule(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], keep: float) -> list[Condition]:
    """Add the condition of best FOIL gain until no negative is covered.

    A cut may lose no more than 1 - ``keep`` of the positives covered.  Of the
    thresholds that split the sample alike, the one of fewest decimals is taken.
    """
    rule: list[Condition] = []
    inside = np.ones(len(y), bool)
    while (inside & ~y).any() and len(rule) < 3 * len(names):
        p, n = int((inside & y).sum()), int((inside & ~y).sum())
        if not p:
            break
        best: tuple[float, Condition] | None = None
        for f, name in enumerate(names):
            values = x[inside, f]
            labels = y[inside]
            good = np.sort(values[labels])
            spare = int((1 - keep) * p)
            for op, sign in ((">=", 1.0), ("<=", -1.0)):
                own = np.sort(sign * good)
                bad = np.sort(sign * values[~labels])
                for edge in np.unique(own[: spare + 1]):
                    out = int(np.searchsorted(bad, edge))  # negatives cut off
                    if not out:
                        continue
                    left = p - int(np.searchsorted(own, edge))
                    gain = left * (np.log2(left / (left + n - out)) - np.log2(p / (p + n)))
                    below, above = sign * bad[out - 1], sign * edge
                    value = roundest(np.nextafter(below, np.inf), above) if sign > 0 else -roundest(np.nextafter(-below, np.inf), -above)
                    if best is None or gain > best[0] + 1e-12:
                        best = gain, Condition(name, op, value)
        if best is None or best[0] <= 0:
            break
        rule.append(best[1])
        inside &= best[1].holds(x, names)
    return rule


def settle_rule(rule: list[Condition], x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> list[Condition]:
    """Each threshold anew, given the other conditions: the number of fewest decimals between the outermost positive and the first negative beyond it.

    While a rule is grown most negatives beyond a cut also fail conditions yet to
    come; once these are known, only a few bound the threshold.
    """
    for i, c in enumerate(rule):
        inside = covers(rule[:i] + rule[i + 1 :], x, names)
        values = x[inside, names.index(c.feature)]
        labels = y[inside]
        sign = 1.0 if c.op == ">=" else -1.0
        held = sign * values[labels & (sign * values >= sign * c.value)]
        if not len(held):
            continue
        edge = held.min()
        beyond = sign * values[~labels & (sign * values < edge)]
        if len(beyond):
            # as numbers of the feature: the range between them, closed at the positive end
            low, high = np.nextafter(beyond.max(), np.inf), edge
            value = roundest(low, high) if sign > 0 else roundest(-high, np.nextafter(-low, -np.inf))
            rule = [*rule[:i], Condition(c.feature, c.op, value), *rule[i + 1 :]]
    return rule


def covers(rule: list[Condition], x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    inside = np.ones(len(x), bool)
    for c in rule:
        inside &= c.holds(x, names)
    return inside


def prune_rule(rule: list[Condition], x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> list[Condition]:
    """The shortest rule, by dropping single conditions, that is no worse on the pruning part by (p - n) / (p + n)."""

    def worth(r: list[Condition]) -> float:
        inside = covers(r, x, names)
        p, n = int((inside & y).sum()), int((inside & ~y).sum())
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1:
        options = [rule[:i] + rule[i + 1 :] for i in range(len(rule))]
        best = max(options, key=worth)
        if worth(best) < worth(rule) or (worth(best) == worth(rule) and not y.any()):
            return rule
        rule = best
    return rule


def induce_rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = FEATURES, keep: float = 1.0, seed: int = 5, most: int = 20) -> list[list[Condition]]:
    """Ordered rules for the positive class; what no rule covers is negative."""
    rng = np.random.default_rng(seed)
    rules: list[list[Condition]] = []
    part = rng.random(len(y)) < 2 / 3
    while y.any() and len(rules) < most:
        grow, check = part, ~part
        if not (y & grow).any():
            break
        rule = grow_rule(x[grow], y[grow], names, keep)
        if not rule:
            break
        if (y & check).any():
            rule = prune_rule(rule, x[check], y[check], names)
            inside = covers(rule, x[check], names)
            if (inside & y[check]).sum() * 2 < inside.sum():
                break
        rule = settle_rule(rule, x, y, names)
        inside = covers(rule, x, names)
        rules.append(rule)
        x, y, part = x[~inside], y[~inside], part[~inside]
    return rules


def rules_sql(rules: list[list[Condition]], positive: str = "prose", negative: str = "other") -> str:
    """The rule list as a SQL CASE expression."""
    if not rules:
        return f"'{negative}'"
    arms = " ".join(f"WHEN {' AND '.join(c.sql() for c in r)} THEN '{positive}'" for r in rules)
    return f"CASE {arms} ELSE '{negative}' END"


def labelled_sample(statistics: DataFrame, label: Column, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample`` documents, taken by hash of the id whatever the size of the table."""
    filled = statistics.where("n_words > 0")
    # a hash range of about the sample's share comes first: else every task would offer a whole sample to the driver
    share = min(1.0, 1.2 * sample / max(1, filled.count()))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    picked = filled.where(rank < int(share * 1_000_000)).withColumn("label", label).orderBy(rank, "doc_id").limit(sample)
    rows = picked.select(*[F.col(f).cast("double") for f in FEATURES], "label").toPandas()
    return rows[list(FEATURES)].fillna(0.0).to_numpy(float), rows["label"].to_numpy(bool)


def learn_prose_rules(statistics: DataFrame, label: Column, sample: int = SAMPLE_DOCUMENTS) -> list[list[Condition]]:
    """Rules for ``label`` from at most ``sample`` documents."""
    x, y = labelled_sample(statistics, label, sample)
    return induce_rules(x, y) if len(y) else []


def complete_rules(statistics: DataFrame, label: Column, rules: list[list[Condition]], sample: int = SAMPLE_DOCUMENTS, rounds: int = 20) -> list[list[Condition]]:
    """Rules that agree with ``label`` on all documents, from rules learned on a sample, which may lack the outermost documents.

    Documents on which rules and label differ are sought in the whole table and learned
    from (at most ``sample`` a round): conditions are settled anew with those the rules
    take in wrongly, and what no rule covers gets a further rule.  No rules are returned
    if some still differ after ``rounds``, so that the caller goes by the definition.
    """
    if not rules:
        return []
    x, y = labelled_sample(statistics, label, sample)
    for _ in range(rounds):
        wrong = statistics.where(label != (F.expr(rules_sql(rules)) == "prose"))
        if wrong.isEmpty():
            return rules
        more_x, more_y = labelled_sample(wrong, label, sample)
        x, y = np.concatenate([x, more_x]), np.concatenate([y, more_y])
        # a rule that takes in others than positives gets conditions against them
        kept: list[list[Condition]] = []
        left = np.ones(len(y), bool)
        for rule in rules:
            rule = settle_rule(rule, x[left], y[left], FEATURES)
            inside = left & covers(rule, x, FEATURES)
            if (inside & ~y).any() and (inside & y).any():
                rule = settle_rule([*rule, *grow_rule(x[inside], y[inside], FEATURES, 1.0)], x[left], y[left], FEATURES)
                inside = left & covers(rule, x, FEATURES)
            if (inside & y).any() and not (inside & ~y).any():
                kept.append(rule)
                left &= ~inside
        if y[left].any():
            rule = settle_rule(grow_rule(x[left], y[left], FEATURES, 1.0), x[left], y[left], FEATURES)
            if rule:
                kept.append(rule)
        if not kept:
            return []
        rules = kept
    return []
