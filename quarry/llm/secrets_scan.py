"""Secret scan: fixed patterns, and credential formats learned by grammar inference.

The strings that the patterns find are labelled credentials. Per kind, a prefix tree of their character classes is merged, state
by state, while the merged states' choices are statistically compatible (Hoeffding bound), into a probabilistic automaton: first
within a depth, so that rare states are pooled and lengths kept, then across depths. Its states also keep which characters they saw. Every
other long token is scored by the best automaton's likelihood against that of an ordinary token or an identifier of random characters;
tokens likelier by a margin in bits, per character and in all, are secrets of the learned formats. Random characters of the whole alphabet
without a fixed beginning cannot be told from identifiers and are found by the patterns only.

The automata are fitted on a bounded sample (`PER_KIND` distinct strings of each kind, `ORDINARY` ordinary tokens, taken by MD5; of a
string the first `MAX_SYMBOLS` characters, after which it counts as going on); all texts are searched whole. Candidates are all runs of
credential characters that hold a letter and a digit, from the shortest credential learned (`LEAST`) on: a run of letters only cannot be told
from a word by its format.

Defined cases: null and empty texts have no spans (the digest of no spans is that of the empty string); texts without any
credential teach nothing, then only the base patterns find spans; every input row gives one row, repeated rows too; very long texts are searched
whole; ids pass through unchanged, null included; empty tables give an empty result; other columns are ignored (`redact` keeps
them); spans count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, cut, text_of, with_python

#: Order of kinds at equal starts; the last is the method's own.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Runs long enough for an access key or a hex string, or to be a candidate.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
#: An ordinary token, for comparison.
PLAIN = re.compile(r"[A-Za-z0-9+/_.=-]{4,}")
PER_KIND, ORDINARY, MAX_SYMBOLS = 1500, 4000, 128
#: Least length of a learned credential, and so of a candidate.
LEAST = 8
#: Least gain of a format over ordinary tokens, in bits a character and in all: short strings must be the likelier to count.
MARGIN_BITS, TOTAL_BITS, ALPHA = 0.5, 20.0, 0.05
#: Candidates whose verdict a worker remembers.
MEMORY = 200_000


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the fixed patterns, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in RUN.finditer(text):
        a, s = run.start(), run[0]
        if "AKIA" in s:
            out += [(a + m.start(), a + m.end(), "access", m[0]) for m in ACCESS.finditer(s) if len(m[0]) >= 20]
        out += [(a + m.start(), a + m.end(), "hex", m[0]) for m in HEX.finditer(s) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


#: Character classes: (symbol, characters).
CLASSES = {"d": "0123456789", "a": "abcdef", "l": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "L": "GHIJKLMNOPQRSTUVWXYZ", "p": "+/_.=-"}
CLASS = {c: s for s, cs in CLASSES.items() for c in cs}
SYMBOL = str.maketrans(CLASS)
SIZE = {s: len(cs) for s, cs in CLASSES.items()}
#: Pseudo-count of a step or an end that was not seen; states seen less often are not merged with states of another depth.
UNSEEN, LEAST_SEEN = 0.02, 12


def symbols(token: str) -> str:
    return token.translate(SYMBOL)


@dataclass
class Automaton:
    """Probabilistic automaton over characters; state 0 starts. Of a state, `steps` has (target, bits) of the characters seen there, and of each
    class, as `<class>`, those of its other characters; a class not seen restarts."""

    steps: list[dict[str, tuple[int, float]]] = field(default_factory=list)
    ends: list[float] = field(default_factory=list)

    def bits(self, token: str) -> float:
        """Bits of information of the token under the automaton: less is likelier."""
        state, total = 0, 0.0
        for c in token:
            now = self.steps[state]
            state, b = now.get(c) or now[f"<{CLASS[c]}>"]
            total += b
        return total - math.log2(self.ends[state])


class PrefixTree:
    """Counts of the tokens' class sequences, whose states are merged first within a depth, then across depths."""

    def __init__(self, tokens: list[str]):
        self.tokens = tokens
        self.next: list[dict[str, list]] = [{}]  # symbol -> [target, count]
        self.end, self.seen = [0], [0]
        self.joined: dict[int, int] = {}  # a state that was merged -> the state that took it
        for t in tokens:
            at = 0
            self.seen[0] += 1
            for s in symbols(t[:MAX_SYMBOLS]):
                if s not in self.next[at]:
                    self.next[at][s] = [len(self.next), 0]
                    self.next.append({})
                    self.end.append(0)
                    self.seen.append(0)
                step = self.next[at][s]
                step[1] += 1
                at = step[0]
                self.seen[at] += 1
            self.end[at] += len(t) <= MAX_SYMBOLS

    def state(self, q: int) -> int:
        while q in self.joined:
            q = self.joined[q]
        return q

    def step(self, q: int, s: str) -> int:
        """Where symbol s leads from q."""
        edge = self.next[q][s]
        edge[0] = self.state(edge[0])
        return edge[0]

    def _differ(self, f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether ends and steps of a and b, and of all that follow them alike, may come from one state."""
        todo, done = [(a, b)], {(a, b)}
        while todo:
            a, b = todo.pop()
            if self._differ(self.end[a], self.seen[a], self.end[b], self.seen[b], alpha):
                return False
            for s in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(s), self.next[b].get(s)
                if self._differ(x[1] if x else 0, self.seen[a], y[1] if y else 0, self.seen[b], alpha):
                    return False
                if x and y:
                    pair = self.step(a, s), self.step(b, s)
                    if pair[0] != pair[1] and pair not in done:
                        done.add(pair)
                        todo.append(pair)
        return True

    def join(self, a: int, b: int) -> None:
        """State a takes b, and what follows b joins what follows a alike."""
        todo = [(a, b)]
        while todo:
            a, b = map(self.state, todo.pop())
            if a == b:
                continue
            self.joined[b] = a
            self.end[a] += self.end[b]
            self.seen[a] += self.seen[b]
            for s, (t, n) in self.next[b].items():
                if s in self.next[a]:
                    self.next[a][s][1] += n
                    todo.append((self.next[a][s][0], t))
                else:
                    self.next[a][s] = [t, n]
            self.next[b] = {}

    def below(self, layer: list[int]) -> list[int]:
        """The states one step below, those seen most first."""
        return sorted({self.step(q, s) for q in layer for s in self.next[q]}, key=lambda q: (-self.seen[q], q))

    def merged(self, alpha: float = ALPHA, least: int = 0) -> Automaton:
        """Within each depth from the start down, a state joins the first compatible one: rare states so are pooled with others that are as far
        from the start, and ends stay at their length. Then states of different depths join, where both were seen often enough to tell. States seen less than `least` times count as not seen: no
        single token is learned by heart."""
        layer = [0]
        while layer := self.below(layer):
            kept: list[int] = []
            for q in layer:
                fit = next((k for k in kept if self.compatible(k, q, alpha)), None)
                if fit is None:
                    kept.append(q)
                else:
                    self.join(fit, q)
            layer = kept
        settled, layer = [0], [0]
        while layer := [q for q in self.below(layer) if q not in settled]:
            for q in layer:
                q = self.state(q)
                if q in settled:
                    continue
                often = [k for k in settled if min(self.seen[k], self.seen[q]) >= LEAST_SEEN]
                fit = next((k for k in often if self.compatible(k, q, alpha)), None)
                if fit is None:
                    settled.append(q)
                else:
                    self.join(fit, q)
                settled = [k for k in settled if k not in self.joined]
            layer = [q for q in layer if q in settled] or []
        return self._automaton(least)

    def _automaton(self, least: int) -> Automaton:
        """Probabilities of classes, and of the characters in them: each token takes its one way through the merged states once more."""
        reached, todo = {0: 0}, [0]
        while todo:
            q = todo.pop()
            for s in sorted(self.next[q]):
                if self.seen[t := self.step(q, s)] < least:
                    del self.next[q][s]
                elif t not in reached:
                    reached[t] = len(reached)
                    todo.append(t)
        chars: dict[int, dict[str, int]] = {q: {} for q in reached}
        for token in self.tokens:
            q = 0
            for c in token[:MAX_SYMBOLS]:
                if CLASS[c] not in self.next[q]:
                    break
                chars[q][c] = chars[q].get(c, 0) + 1
                q = self.step(q, CLASS[c])
        steps, ends = [], []
        for q in reached:
            n, here = self.seen[q] + UNSEEN * (len(SIZE) + 1), {}
            for s, size in SIZE.items():
                to, m = (reached[self.step(q, s)], self.next[q][s][1]) if s in self.next[q] else (0, 0)
                own = -math.log2((m + UNSEEN) / n) + math.log2(m + size)
                here[f"<{s}>"] = to, own
                here |= {c: (to, own - math.log2(chars[q][c] + 1)) for c in CLASSES[s] if c in chars[q]}
            steps.append(here)
            ends.append((self.end[q] + UNSEEN) / n)
        return Automaton(steps, ends)


#: Shapes of ordinary identifiers and the bits of a character there: lower or upper case with digits, both, grouped hex, any.
IDENTIFIERS = [(re.compile(p), math.log2(n)) for p, n in (("[a-z0-9]+", 36), ("[A-Z0-9]+", 36), ("[A-Za-z0-9]+", 62), ("[0-9a-fA-F]+([-_.][0-9a-fA-F]+)+", 17), (".+", 68))]
#: Bits of being an identifier at all, one token in a hundred, and of its shape; lengths are spread evenly by their logarithm.
RARE_BITS = math.log2(100) + math.log2(len(IDENTIFIERS))
LENGTHS = math.log(256 / LEAST)


@dataclass
class Formats:
    """Automata of the credential kinds and of ordinary tokens, the margin of each kind, and the least length of its secrets."""

    automata: dict[str, Automaton] = field(default_factory=dict)
    ordinary: Automaton | None = None
    margins: dict[str, float] = field(default_factory=dict)
    least: dict[str, int] = field(default_factory=dict)

    def plain_bits(self, token: str) -> float:
        """Bits of the token as what texts hold else: a token as those of the ordinary sample, or an identifier of random characters."""
        each = min(b for p, b in IDENTIFIERS if p.fullmatch(token))
        return min(self.ordinary.bits(token), RARE_BITS + each * len(token) + math.log2(LENGTHS * len(token)))

    def gain(self, kind: str, token: str) -> float:
        return (self.plain_bits(token) - self.automata[kind].bits(token)) / len(token)

    def kind_of(self, token: str) -> str | None:
        """The kind whose format the token has, if its likelihood exceeds that of ordinary tokens by the margins."""
        plain = self.plain_bits(token)
        best = max(((plain - a.bits(token), k) for k, a in self.automata.items() if len(token) >= self.least.get(k, LEAST)), default=(0.0, ""))
        return best[1] if best[1] and best[0] >= max(self.margins[best[1]] * len(token), TOTAL_BITS) else None

    def is_secret(self, token: str, seen: dict[str, bool]) -> bool:
        if token not in seen:
            if len(seen) >= MEMORY:
                seen.clear()
            seen[token] = self.kind_of(token) is not None
        return seen[token]


#: Runs of credential characters with a letter and a digit.
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])(?=[0-9+/_.=-]*[A-Za-z])[A-Za-z0-9+/_.=-]{{{LEAST},}}")


def candidates(text: str, taken: list[tuple]) -> Iterator[tuple[int, int, str]]:
    """Runs with letters and digits outside the base spans, which are sorted by their starts."""
    i, reach = 0, 0  # base spans that start before the run's end, and how far they reach
    for m in CANDIDATE.finditer(text):
        t = m[0].strip("=.-_/+")
        a = m.start() + m[0].index(t)
        b = a + len(t)
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if len(t) >= LEAST and reach <= a:
            yield a, b, t


def learn(docs: DataFrame, per_kind: int = PER_KIND, ordinary: int = ORDINARY) -> Formats:
    """Formats from the strings that the patterns find in `docs`, and from its ordinary tokens."""

    def run(texts):
        rows, kinds, tokens = [], [], []
        for i, text in enumerate(texts.to_pylist()):
            spans = base_spans(text)
            found = [(k, t) for _, _, k, t in spans if len(t) >= LEAST]
            words = text.split()
            if words and not spans:
                found = [("ordinary", w) for w in (words[len(words) // 3], words[2 * len(words) // 3]) if PLAIN.fullmatch(w)]
            rows += [i] * len(found)
            kinds += [k for k, _ in found]
            tokens += [t for _, t in found]
        return rows, [kinds, tokens]

    # The corpus is read once; all kinds are ranked in what it gives.
    found = cut(with_python(docs, [], [text_of()], "kind string, token string", run).distinct())
    got: dict[str, list[str]] = {}
    for kind in (*KINDS[:3], "ordinary"):
        rows = found.filter(F.col("kind") == kind).orderBy(F.md5("token"), "token").limit(ordinary if kind == "ordinary" else per_kind)
        got[kind] = [r.token for r in rows.collect()]
    out = Formats(ordinary=PrefixTree(got["ordinary"]).merged(least=LEAST_SEEN))
    for kind in KINDS[:3]:
        if len(got[kind]) >= 5:
            out.automata[kind] = PrefixTree(got[kind]).merged()
            gains = sorted(out.gain(kind, t) for t in got[kind])
            # Half the length, and half of what nearly all learned strings gain: a string of another length gains less.
            out.least[kind] = max(LEAST, min(map(len, got[kind])) // 2)
            out.margins[kind] = max(MARGIN_BITS, gains[len(gains) // 50] / 2)
    return out


def spans(text: str, formats: Formats, seen: dict[str, bool] | None = None) -> list[tuple[int, int, str, str]]:
    base, seen = base_spans(text), {} if seen is None else seen
    more = [(a, b, "format", t) for a, b, t in candidates(text, base) if formats.is_secret(t, seen)] if formats.automata else []
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(found: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in found)


def secret_digest(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format for every row of docs."""
    formats = formats or learn(docs)

    def run(texts):
        seen: dict[str, bool] = {}
        found = [spans(t, formats, seen) for t in texts.to_pylist()]
        count = lambda k: [sum(x[2] == k for x in s) for s in found]
        base = [joined([x for x in s if x[2] != "format"]) for s in found]
        return None, [count("assign"), count("access"), count("hex"), [hashlib.sha256(x.encode()).hexdigest() for x in base], [joined(s) for s in found], count("format")]

    new = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long"
    return with_python(docs, [F.col("doc_id").cast("long")], [text_of()], new, run).withColumnRenamed("k0", "doc_id")


def redacted(text: str, formats: Formats, mark: str = "[SECRET]", seen: dict[str, bool] | None = None) -> str:
    out, at = [], 0
    for a, b, _, t in spans(text, formats, seen):
        a = b - len(t)  # of an assignment, only the value
        if b <= at:
            continue
        out += [text[at : max(a, at)], mark if a >= at else ""]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """docs with every secret in `text` replaced; other columns stay as they are, null texts stay null."""
    formats = formats or learn(docs)

    def run(texts):
        seen: dict[str, bool] = {}
        return None, [[None if t is None else redacted(t, formats, seen=seen) for t in texts.to_pylist()]]

    text = docs.columns.index("text")
    keep = [F.lit(True) if i == text else c for i, c in enumerate(columns_of(docs))]
    out = with_python(docs, keep, [F.col("text").cast("string")], "clear string", run)
    return out.select(*[F.col("clear" if i == text else f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
