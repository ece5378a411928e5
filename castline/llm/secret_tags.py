"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

The patterns find what is written as a secret usually is; every one of their spans stays. The
field tags each token as the begin of a secret, inside or outside of one, by its shape, its
neighbours' words and facts of the whole text, so it also finds values that no pattern names. It
learns from windows about the patterns' own spans (also with values and names of other kinds
put in their place) and from windows of texts without any. Texts are decoded by Viterbi: tokens
that every best path leaves outside are told by a bound, side by side, and only the runs between
them are walked through.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castline.llm.common import forget_others

#: The patterns, and how long a match (of assign: its second group) has to be.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
PATTERNS = (("assign", re.compile(ASSIGN, re.IGNORECASE | re.ASCII), 2, 6), ("access", re.compile(ACCESS), 0, 20), ("hex", re.compile(HEX), 0, 24))
KINDS = ("assign", "access", "hex", "crf")
HEX_LETTERS = set("0123456789abcdef")
#: Letters of tokens whose own words are features.
SHORT = 12
named = re.compile("password|passwd|secret|token|api_?key").search
named_alike = re.compile("password|passwd|secret|token|key|auth|pwd|credential").search

#: Words with the signs that keys consist of, and the signs that assign.
tokens_in = re.compile(r"[\w+/.-]+(?:={1,2}(?![\w+/.-]))?|[=:]")
#: Letters of a text that are cut into tokens at once; cuts lie at white space.
TOGETHER = 1 << 20
gap = re.compile(r"\s")

BEGIN, INSIDE, OUTSIDE = 0, 1, 2
TAGS = 3
#: Places of a token's features relative to the token that they speak for.
AROUND = (0, -2, -1, 1)

#: The training sample: texts with and without spans, windows of each text (and one more of a text without), tokens on each side of a window's middle.
TRAIN_TEXTS, WINDOWS, REACH = 1000, 2, 6
#: Features that are learned at most, the most frequent ones, and how often they have to occur.
FEATURES, LEAST = 20_000, 3
STEPS, RATE, DECAY = 80, 0.1, 1e-3
#: By how much a tag has to be better than outside: the sample holds secrets far oftener than texts do.
CAUTION = 2.0


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of the patterns' matches, in the order of starts, then of kinds."""
    found = [(kind, m.start(), m.end(), m.start(group)) for kind, pattern, group, least in PATTERNS for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def cuts(text: str) -> Iterable[tuple[int, int]]:
    """Runs of a text that end at white space, each of TOGETHER letters or a little more."""
    start = 0
    while start < len(text):
        end = gap.search(text, start + TOGETHER)
        end = end.start() if end else len(text)
        yield start, end
        start = end


def token_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for start, end in cuts(text) for m in tokens_in.finditer(text, start, end)]


def plain_word(bare: str) -> tuple[str, int, bool] | None:
    """Case, length and whether it is ASCII of a word of letters in one case, which tell all of its shape; None for other tokens."""
    if not bare.isalpha():
        return None
    case = "low" if bare.islower() else "title" if bare.istitle() else "up" if bare.isupper() else None
    return case and (case, min(len(bare), 64), bare.isascii())


def band(size: int) -> int:
    return min(size.bit_length(), 8) if size < 20 else 8 + min(size // 8, 8)


def plain_features(case: str, size: int, ascii_only: bool) -> list[str]:
    return [f"plain {case} {band(size)}", f"plain {size // 4}", f"plain {case}", f"ascii {ascii_only}"]


def word_features(lower: str) -> list[str]:
    """The word itself and whether it names a secret, of a short token."""
    return [f"word {lower}", f"names {named_alike(lower) is not None}"] if len(lower) <= SHORT else []


def shape_features(token: str) -> list[str]:
    """What a token looks like, in a few words; its own word is among them where it is short."""
    bare = token.strip("._-/=+")
    size = len(bare)
    if not size:
        return [f"sign {token[:2]}"]
    lower = bare.lower()
    if plain := plain_word(bare):
        return plain_features(*plain) + word_features(lower)
    letters, digits = sum(map(str.isalpha, bare)), sum(map(str.isdigit, bare))
    other = size - letters - digits
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(bare, bare[1:]))
    cases = "up" if bare.isupper() else "low" if bare.islower() else "title" if bare.istitle() else "mixed" if letters else "none"
    mix = ("letters" if letters else "") + (" digits" if digits else "") + (" signs" if other else "")
    features = [f"mix {mix}", f"size {band(size)}", f"mix and size {mix} {band(size)}", f"case {cases} {bool(digits)}", f"turns {min(turns, 12) // 2}"]
    if size >= 8:
        counts = Counter(bare)
        spread = -sum(n / size * math.log2(n / size) for n in counts.values())
        features += [f"spread {int(2 * spread)} {mix}", f"hex {set(lower) <= HEX_LETTERS} {band(size)}", f"ascii {bare.isascii()}", f"doubled {max(counts.values()) * 3 > size}"]
        if other:
            features.append("signs " + "".join(sorted({c for c in bare if not c.isalnum()}))[:3])
    return features + word_features(lower)


def text_features(text: str) -> list[str]:
    """Facts of a whole text: how long it is, how much of it assigns, quotes or nests."""
    size = max(len(text), 1)
    share = lambda signs: min(9, int(1000 * sum(map(text.count, signs)) / size)) // 3
    return [f"text size {min(size.bit_length(), 16) // 2}", f"assigns {share('=:')}", f"quotes {share(QUOTES)}", f"nests {share('{}<>;')}"]


QUOTES = "\"'`"


@dataclass(frozen=True)
class Field:
    """Weights of a linear chain: of features by name (a row of tags for each place of AROUND), of texts' facts, and of one tag after another."""

    own: dict[str, np.ndarray]
    facts: dict[str, np.ndarray]
    steps: np.ndarray
    plain: dict[tuple[str, int, bool], np.ndarray] = field(default_factory=dict)

    def token_rows(self, token: str) -> np.ndarray:
        """What a token says of itself and of those around it: one row of tags for each place of AROUND."""
        bare = token.strip("._-/=+")
        plain = plain_word(bare)
        if plain is None:
            return self.summed(shape_features(token))
        rows = self.plain.get(plain)
        if rows is None:
            rows = self.plain[plain] = self.summed(plain_features(*plain))
        for feature in word_features(bare.lower()):
            known = self.own.get(feature)
            if known is not None:
                rows = rows + known
        return rows

    def summed(self, features: list[str]) -> np.ndarray:
        return sum((self.own[f] for f in features if f in self.own), np.zeros((len(AROUND), TAGS)))

    def fact_row(self, text: str) -> np.ndarray:
        """What a whole text says of each of its tokens, and the lead that outside has anyway."""
        return sum((self.facts[f] for f in text_features(text) if f in self.facts), np.eye(TAGS)[OUTSIDE] * CAUTION)

    def lead(self) -> np.ndarray:
        """By how much OUTSIDE has to lead a tag at a token so that every best path is outside there.

        To put OUTSIDE in a path in place of a tag changes two steps, or one at either end; this is the most that it can cost.
        """
        into = np.vstack([self.steps, np.zeros((1, TAGS))])
        out = np.hstack([self.steps, np.zeros((TAGS, 1))])
        return np.array([(into[:, s] - into[:, OUTSIDE]).max() + (out[s] - out[OUTSIDE]).max() for s in (BEGIN, INSIDE)])


def viterbi(scores: np.ndarray, steps: np.ndarray, before: int | None = None, after: int | None = None) -> list[int]:
    """The best tags for rows of scores; ``before`` and ``after`` are fixed tags around them."""
    best = scores[0] + (steps[before] if before is not None else 0)
    back = []
    for row in scores[1:]:
        ways = best[:, None] + steps
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + row
    tags = [int((best + (steps[:, after] if after is not None else 0)).argmax())]
    for way in reversed(back):
        tags.append(int(way[tags[-1]]))
    return tags[::-1]


class Numbers(dict):
    """The numbers of tokens, and what they say, for those met since it was emptied."""

    LONG, NAMED = 1, 2

    def __init__(self, field: Field | None):
        super().__init__()
        self.field, self.letters = field, 0
        self.rows, self.marks = np.zeros((1024, len(AROUND), TAGS)), np.zeros(1024, np.int8)

    def __missing__(self, token: str) -> int:
        found = self[token] = len(self)
        if found == len(self.rows):
            self.rows, self.marks = np.concatenate([self.rows, np.zeros_like(self.rows)]), np.concatenate([self.marks, np.zeros_like(self.marks)])
        if self.field:
            self.rows[found] = self.field.token_rows(token)
        lower = token.lower()
        self.marks[found] = (self.LONG if len(token) >= 20 else 0) | (self.NAMED if named(lower) else 0)
        self.letters += len(token)
        return found


class Tagger:
    """Decodes texts; what tokens say is kept for a bounded number of them."""

    MOST, MOST_LETTERS, SLICE = 200_000, 8 << 20, 1 << 18

    def __init__(self, field: Field | None):
        self.field = field
        self.lead = field.lead() if field else None
        self.numbers = Numbers(field)

    def tags(self, codes: np.ndarray, facts: np.ndarray) -> dict[int, int]:
        """The tags of the tokens that are not outside, by place."""
        rows, found = self.numbers.rows, {}
        spoken: list[tuple[int, np.ndarray]] = []
        for start in range(0, len(codes), self.SLICE):
            stop = min(start + self.SLICE, len(codes))
            scores = np.broadcast_to(facts, (stop - start, TAGS)).copy()
            for nth, shift in enumerate(AROUND):
                first, last = max(start + shift, 0), min(stop + shift, len(codes))
                scores[first - shift - start : last - shift - start] += rows[codes[first:last], nth]
            open_ = np.flatnonzero((scores[:, OUTSIDE, None] - scores[:, :2] <= self.lead).any(axis=1))
            spoken.extend((start + int(i), scores[i]) for i in open_)
        run: list[tuple[int, np.ndarray]] = []
        for place, row in [*spoken, (len(codes) + 1, None)]:
            if run and place != run[-1][0] + 1:
                before = OUTSIDE if run[0][0] > 0 else None
                after = OUTSIDE if run[-1][0] + 1 < len(codes) else None
                best = viterbi(np.array([r for _, r in run]), self.field.steps, before, after)
                found |= {at: tag for (at, _), tag in zip(run, best) if tag != OUTSIDE}
                run = []
            run.append((place, row))
        return found

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All spans of a text: the patterns' and those that the field adds."""
        if len(self.numbers) > self.MOST or self.numbers.letters > self.MOST_LETTERS:
            self.numbers = Numbers(self.field)
        number = self.numbers.__getitem__
        codes = np.concatenate([np.fromiter(map(number, tokens_in.findall(text, *cut)), np.int32) for cut in cuts(text)]) if text else np.zeros(0, np.int32)
        marks = int(np.bitwise_or.reduce(self.numbers.marks[codes])) if len(codes) else 0
        # All signs of a match but those about an assigned value lie in one token.
        base = base_spans(text) if marks else []
        tags = self.tags(codes, self.field.fact_row(text)) if self.field and len(codes) else {}
        added = []
        if tags:
            places = token_spans(text)
            last = None
            for at, tag in sorted(tags.items()):
                start, end = places[at]
                if tag == INSIDE and last == at - 1:
                    added[-1][1] = end
                else:
                    added.append([start, end])
                last = at
        spans = [(kind, start, end) for kind, start, end, _ in base]
        for start, end in added:
            start, end = trimmed(text, start, end)
            if start < end and not any(a < end and start < b for _, a, b, _ in base):
                spans.append(("crf", start, end))
        return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the full stops and dashes around it."""
    while start < end and text[start] in ".-/":
        start += 1
    while end > start and text[end - 1] in ".-/":
        end -= 1
    return start, end


def windows(text: str, rng: random.Random) -> list[tuple[list[str], list[int]]]:
    """Tokens and tags of a few windows of a text: about the patterns' values, or where a token could be taken for one."""
    places, base = token_spans(text), base_spans(text)
    if not places:
        return []
    tags, starts = [OUTSIDE] * len(places), np.array([a for a, _ in places])
    middles = []
    for _, _, end, value in base:
        inside = False
        for at in range(max(0, int(np.searchsorted(starts, value, "right")) - 1), len(places)):
            if places[at][0] >= end:
                break
            if places[at][1] > value:
                if tags[at] == OUTSIDE:
                    tags[at] = INSIDE if inside else BEGIN
                if not inside:
                    middles.append(at)
                inside = True
    if not middles:
        odd = [at for at, (a, b) in enumerate(places) if b - a >= 12 or any(c.isdigit() for c in text[a:b])]
        middles = [*rng.sample(odd, min(WINDOWS, len(odd))), rng.randrange(len(places))]
    else:
        middles = rng.sample(middles, min(WINDOWS, len(middles)))
    found = []
    for middle in middles:
        low, high = max(0, middle - REACH), middle + REACH + 1
        found.append(([text[a:b] for a, b in places[low:high]], tags[low:high]))
    return found


ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
OTHER_HEX_LETTERS = set("0123456789abcdef")
#: Letters of tokens whose own words are features.
SHORT = 12
OTHER_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "key", "auth", "credential", "pwd")


def varied(tokens: list[str], tags: list[int], rng: random.Random) -> list[str]:
    """A window with values, and a name before them, of other kinds."""
    tokens = list(tokens)
    for at, tag in enumerate(tags):
        if tag != OUTSIDE:
            letters = rng.choice(ALPHABETS)
            tokens[at] = "".join(rng.choice(letters) for _ in range(rng.randint(16, 48)))
            for before in (at - 1, at - 2):
                if before >= 0 and named(tokens[before].lower()):
                    tokens[before] = rng.choice(OTHER_NAMES)
    return tokens


def training_windows(documents: DataFrame, seed: int = 5) -> list[tuple[list[str], list[int], list[str]]]:
    """(tokens, tags, facts) of windows of at most ``TRAIN_TEXTS`` texts with spans and as many without, chosen by hashes of the texts.

    The same texts come again on every run; a text that recurs is taken once.
    """
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30))

    def cut(batches):
        for batch in batches:
            rows = []
            for drawn, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(drawn, tokens, tags, text_features(text)) for tokens, tags in windows(text, random.Random(drawn))]
            kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()))
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names=["draw", "tokens", "tags", "facts"])

    texts = documents.select(draw.alias("draw"), "text").where("text IS NOT NULL")
    # Cheap tests first: most texts hold no name of a secret.
    names = " OR ".join(f"contains(lower(text), '{name}')" for name in ("passw", "secret", "token", "apikey", "api_key"))
    assigned = r"text RLIKE '(?i)(password|passwd|secret|token|api_?key)[\"\']? *[:=]'"
    likely = F.expr(f"(({names}) AND {assigned}) OR (contains(text, 'AKIA') AND text RLIKE 'AKIA[A-Z0-9]{{16}}') OR text RLIKE '[0-9a-f]{{24}}'")
    kind = "draw long, tokens array<string>, tags array<int>, facts array<string>"
    held = lambda rows: rows.mapInArrow(cut, kind).distinct().orderBy("draw", F.xxhash64("tokens")).limit(TRAIN_TEXTS * (WINDOWS + 1)).collect()
    share = lambda count: int((1 << 30) * min(1.0, 2.0 * TRAIN_TEXTS / max(count, 1)))
    speaking = texts.where(likely).agg(F.approx_count_distinct("draw")).first()[0]
    spoken = [r for r in held(texts.where((F.col("draw") <= share(speaking)) & likely)) if set(r["tags"]) != {OUTSIDE}]
    plain = held(texts.where((F.col("draw") <= share(documents.count())) & ~likely))
    rng, found = random.Random(seed), []
    for r in spoken:
        found.append((r["tokens"], r["tags"], r["facts"]))
        found.append((varied(r["tokens"], r["tags"], rng), r["tags"], r["facts"]))
    return found + [(r["tokens"], r["tags"], r["facts"]) for r in plain] if spoken else []


def learn(sample: list[tuple[list[str], list[int], list[str]]]) -> Field | None:
    """The field that makes the tags of a bounded sample likeliest (with a pull towards zero), by Adam steps; None for no sample."""
    if not sample:
        return None
    length = max(len(tokens) for tokens, _, _ in sample)
    words = sorted({t for tokens, _, _ in sample for t in tokens})
    shaped = {t: shape_features(t) for t in words}
    known = Counter(f for tokens, _, _ in sample for t in tokens for f in shaped[t])
    own = {f: i for i, (f, n) in enumerate(sorted(known.items(), key=lambda x: (-x[1], x[0]))[:FEATURES]) if n >= LEAST}
    facts = {f: i for i, f in enumerate(sorted({f for _, _, facts in sample for f in facts}))}
    # Which features a word has and which facts a window; which word stands where, the number after the last for none.
    of_word, feature = (np.array(x, np.int64) for x in zip(*[(i, own[f]) for i, t in enumerate(words) for f in shaped[t] if f in own]))
    of_window, fact = (np.array(x, np.int64) for x in zip(*[(i, facts[f]) for i, (_, _, told) in enumerate(sample) for f in told]))
    number = {t: i for i, t in enumerate(words)}
    at = np.full((len(sample), length + 2 * REACH), len(words))
    tags = np.full((len(sample), length), OUTSIDE)
    for i, (tokens, own_tags, _) in enumerate(sample):
        at[i, REACH : REACH + len(tokens)], tags[i, : len(tokens)] = [number[t] for t in tokens], own_tags
    around = [at[:, REACH + shift : REACH + shift + length].ravel() for shift in AROUND]
    alive = at[:, REACH : REACH + length] < len(words)
    cells, wide = alive.size, len(AROUND) * TAGS
    summed = lambda rows, to, size: np.stack([np.bincount(to, row, size) for row in rows.T], axis=1)
    truth = np.eye(TAGS)[tags] * alive[..., None]
    both = alive[:, :-1] & alive[:, 1:]
    seen_steps = np.einsum("nta,ntb->ab", truth[:, :-1] * both[..., None], truth[:, 1:])
    # One row of weights for each feature, then the rows of facts and of steps, filled up.
    weights = np.zeros((len(own) + len(facts) + TAGS, wide))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    n, m = len(own), len(own) + len(facts)
    for step in range(1, STEPS + 1):
        spoken = np.vstack([summed(weights[feature], of_word, len(words)), np.zeros((1, wide))])
        scores = sum(spoken[place, TAGS * nth : TAGS * (nth + 1)] for nth, place in enumerate(around)).reshape(len(sample), length, TAGS)
        scores = scores + summed(weights[n + fact, :TAGS], of_window, len(sample))[:, None]
        at_tag, at_step = marginals(scores, weights[m:, :TAGS], alive)
        off = (at_tag - truth).reshape(cells, TAGS)
        of_words = np.hstack([summed(off, place, len(words) + 1) for place in around])[:-1]
        gradient = np.zeros_like(weights)
        gradient[:n] = summed(of_words[of_word], feature, n)
        gradient[n:m, :TAGS] = summed((at_tag - truth).sum(axis=1)[of_window], fact, len(facts))
        gradient[m:, :TAGS] = at_step - seen_steps
        gradient = gradient / len(sample) + DECAY * weights
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        weights = weights - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    rows = weights[:n].reshape(n, len(AROUND), TAGS)
    return Field({f: rows[i] for f, i in own.items()}, {f: weights[n + i, :TAGS] for f, i in facts.items()}, weights[m:, :TAGS].copy())


def marginals(scores: np.ndarray, steps: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How likely each tag is at each token, and how often one follows another, over chains side by side (forward and backward sums)."""
    n, length, _ = scores.shape

    def total(x: np.ndarray) -> np.ndarray:
        top = x.max(axis=1, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]

    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0]
    for t in range(1, length):
        on = total(forward[:, t - 1, :, None] + steps) + scores[:, t]
        forward[:, t] = np.where(alive[:, t, None], on, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        on = total(np.swapaxes(steps[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None], 1, 2))
        backward[:, t] = np.where(alive[:, t + 1, None], on, 0.0)
    norm = total(forward[:, -1])
    at_tag = np.exp(forward + backward - norm[:, None, None]) * alive[..., None]
    pair = forward[:, :-1, :, None] + steps + (scores[:, 1:] + backward[:, 1:])[:, :, None] - norm[:, None, None, None]
    both = (alive[:, :-1] & alive[:, 1:])[..., None, None]
    return at_tag, np.where(both, np.exp(np.minimum(pair, 0.0)), 0.0).sum(axis=(0, 1))


def fit(documents: DataFrame) -> Field | None:
    """Learn the field from the table itself: see ``training_windows`` for the bounds. Where no pattern matches anything the result is None."""
    return learn(training_windows(documents))


def find_secrets(documents: DataFrame, field: Field | None) -> DataFrame:
    """For every row of ``documents`` (doc_id, text): doc_id and spans, an array of (kind, start, end) in code points, ends exclusive.

    The patterns' spans (kinds assign, access, hex: whole matches, so an assignment begins with
    its name) are always there; kind crf is a value that the field tags and that touches none of
    them. In the order of starts, then of kinds. Null and empty texts have no spans; null and
    repeated ids come back as they are; equal texts have equal spans; without a field only the
    patterns speak; an empty table gives no rows; other columns are not read. Texts of any length
    are read whole.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        forget_others()
        tagger = Tagger(field)
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in tagger.spans(text or "")] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind: string, start: long, end: long>>")


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    """The digest of spans as the query has it."""
    return hashlib.sha256(",".join(f"{kind}:{start}:{end}" for kind, start, end in spans).encode()).hexdigest()
