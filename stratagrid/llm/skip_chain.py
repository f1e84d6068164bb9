"""Personal data by patterns and a skip-chain conditional random field.

The patterns give the base spans. The field then looks at all mentions of a document: the base spans and
whatever else is written like a number, a masked number or an address. Neighbouring mentions share a
potential, and so do distant ones that are the same or similar (the skip edges: the same text, the same last
digits, the same address in another form). Loopy belief propagation over that graph makes the labels of a
document agree; a mention without a base span that comes out as personal data with high probability is a
span too.

The potentials are log-linear and learnt together, from all documents, by the pseudo-likelihood of each
label given its neighbours' labels. The labels are the base spans, so two things keep the field from merely
learning the patterns again: a mention without a base span that repeats one is of unknown label and left
out, and of the base spans that repeat another, half are shown without any feature of their own form, so
that context and neighbours must carry the label. The prior mean of the skip potentials says that repeats
agree; the data overrule it.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, slices, texts_of, written

KINDS = ("email", "ip", "card", "phone")
#: Labels of a mention: none, then the kinds.
LABELS = ("none", *KINDS)
#: Size of the table that features are hashed into, and features of a mention.
BUCKETS = 1 << 14
FEATURES = 7
#: Kinds of edges, each with a table of potentials.
CHAIN, SAME, SIMILAR = 0, 1, 2

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can't start inside a run of digits: an earlier start would have taken the run whole
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: What else may be personal data: runs of digits and signs with seven digits or more, masked numbers that show
#: their last four, words with an @, addresses that write it in brackets.
_NUMBER = re.compile(r"(?<![0-9])\+?\(?[0-9](?:[ ().-]{0,2}[0-9])++")
_LAST_FOUR = re.compile(r"(?<![0-9])[0-9]{4}(?![0-9])")
_BEHIND_AT = re.compile(r"@[^\s<>()\"',;]+")
_ENDS_ADDRESS = frozenset("<>()\"',;@")
_AT_IN_BRACKETS = re.compile(r"[\[({]at[\])}]", re.IGNORECASE)
_BEHIND_BRACKETS = re.compile(r" ?[\w-]+(?: ?(?:[\[({]dot[\])}]|\.) ?[\w-]+)+", re.IGNORECASE)
_BEFORE_BRACKETS = re.compile(r"[\w.+%-]")
_SPELT = ((re.compile(r" ?[\[({]at[\])}] ?", re.IGNORECASE), "@"), (re.compile(r" ?[\[({]dot[\])}] ?", re.IGNORECASE), "."))
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_MAY_HOLD = re.compile(r"[0-9@]|[\[({]at[\])}]", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    return len(part := part.lstrip("0")) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the patterns' matches, by start, then kind."""
    out = []
    if "@" in text:
        end = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                out.append((start, end, 0))
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def masked(text: str) -> list[tuple[int, int]]:
    """Four digits behind groups of two or more of * and x, a blank or hyphen at most between them.

    Found from the digits leftwards, so that each sign is looked at once however long its groups are."""
    out = []
    for m in _LAST_FOUR.finditer(text):
        at, start = m.start(), -1
        while True:
            end = at - 1 if at and text[at - 1] in " -" else at
            at = end
            while at and text[at - 1] in "*xX":
                at -= 1
            if end - at < 2:
                break
            if not at or not (text[at - 1].isalnum() or text[at - 1] in "_*"):
                start = at
        if start >= 0:
            out.append((start, m.end()))
    return out


def in_brackets(text: str) -> list[tuple[int, int]]:
    """Addresses with the at in brackets, found from the bracket to both sides."""
    out, last = [], 0
    for m in _AT_IN_BRACKETS.finditer(text):
        behind = _BEHIND_BRACKETS.match(text, m.end())
        if behind:
            end = m.start() - (m.start() > last and text[m.start() - 1] == " ")
            start = end
            while start > last and _BEFORE_BRACKETS.match(text[start - 1]):
                start -= 1
            if start < end:
                out.append((start, behind.end()))
                last = behind.end()
    return out


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of all mentions: base spans, and what no base span meets with label 0."""
    out = [(s, e, k + 1) for s, e, k in base]
    taken = sorted((s, e) for s, e, _ in base)
    found = []
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            parts = m[0].split(" ")
            if len(parts) > 1 and all(len(_DIGIT.findall(x)) >= 12 for x in parts):  # long numbers side by side
                at = m.start()
                for x in parts:
                    found.append((at, at + len(x)))
                    at += len(x) + 1
            elif len(_DIGIT.findall(m[0])) >= 7:
                found.append(m.span())
        found += masked(text)
    found += in_brackets(text)
    if "@" in text:
        end = 0
        for m in _BEHIND_AT.finditer(text):
            start = m.start()
            while start > end and not text[start - 1].isspace() and text[start - 1] not in _ENDS_ADDRESS:
                start -= 1
            if start < m.start():
                found.append((start, m.end()))
            end = m.end()
    at, end = 0, 0
    for s, e in sorted(found):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if s >= end and not (at < len(taken) and taken[at][0] < e):
            out.append((s, e, 0))
            end = e
    return sorted(out)


def cue(own: str, digits: str) -> str:
    """What a pattern itself looks at, as far as the mention has it."""
    if "@" in own:
        return "address" if re.search(r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]", own) else "at"
    parts = own.split(".")
    if len(parts) == 4 and all(x.isdigit() and _small(x) for x in parts):
        return "quad"
    if 12 <= len(digits) <= 19:
        return "checked" if luhn(digits) else "unchecked"
    return "plus" if own[:1] == "+" else "bare"


def features(text: str, mention: tuple[int, int, int]) -> list[int]:
    """Buckets of the mention's features: five of its form, then the words before and after it."""
    s, e, _ = mention
    own = text[s:e]
    digits = _DIGIT.findall(own)
    runs = re.findall("[0-9]+", own)
    before, after = re.search(r"([^\W\d_]+)[^\w]{0,3}$", text[max(0, s - 40) : s]), re.match(r"[^\w]{0,3}([^\W\d_]+)", text[e : e + 40])
    found = (
        re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", own)), "-".join(str(len(r)) for r in runs), f"{min(len(digits), 20)}{''.join(sorted(set(own) & set(' ().-+*@[]')))}",
        cue(own, "".join(digits)), f"{len(runs)}{own[:1].isdigit()}{'.' in own}", before[1].lower() if before else "", after[1].lower() if after else "")
    return [zlib.crc32(f"{k}|{x}".encode("utf-8", "surrogatepass")) % BUCKETS for k, x in enumerate(found)]


def likenesses(own: str) -> list[tuple[str, str]]:
    """What makes two mentions repeats of one another: ("same", text), or a part that other forms keep."""
    own = own.lower().strip(".,;: ")
    out = [("same", own)]
    digits = "".join(_DIGIT.findall(own))
    for pattern, sign in _SPELT:
        own = pattern.sub(sign, own)
    if "@" in own:
        out.append(("address", own.replace(" ", "")))
    elif not _QUAD.fullmatch(own):
        if len(digits) >= 7:
            out.append(("digits", digits[-7:]))
        if len(digits) == 4 or 12 <= len(digits) <= 19:
            out.append(("masked" if len(digits) == 4 else "card", digits[-4:]))
    return out


def edges(text: str, nodes: list[tuple[int, int, int]], near: int = 80) -> list[tuple[int, int, int]]:
    """(i, j, kind), i < j: chain edges between neighbours at most `near` characters apart, and skip edges.

    Skip edges join each mention to the one before it that it is the same as or similar to (a masked number to a
    card with its last digits), and each mention without a base span to the first base span of each label among
    all its repeats, however far; so there are never more than a few for each mention."""
    found = {(i, i + 1, CHAIN): None for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= near}
    joined, last, first, own = {}, {}, {}, []
    for i, (s, e, label) in enumerate(nodes):
        keys = likenesses(text[s:e])
        # a masked number looks for cards, and cards for it; cards with the same end are not alike
        seek = [("card" if k == "masked" else "masked" if k == "card" else k, v) for k, v in keys]
        for k in seek:
            if k in last:
                joined[last[k], i] = min(joined.get((last[k], i), SIMILAR), SAME if k[0] == "same" else SIMILAR)
        own.append(seek)
        for k in keys:
            last[k] = i
            if label:
                first.setdefault(k, {}).setdefault(label, i)
    for i, seek in enumerate(own):
        if not nodes[i][2]:
            for k in seek:
                for j in first.get(k, {}).values():
                    pair = (min(i, j), max(i, j))
                    joined[pair] = min(joined.get(pair, SIMILAR), SAME if k[0] == "same" else SIMILAR)
    return [*found, *((i, j, k) for (i, j), k in sorted(joined.items()))]


_GRAPHS = "labels binary, features binary, edges binary"


def graphs(docs: DataFrame) -> DataFrame:
    """The mentions of all documents as a written table for training, a row for some documents.

    A label is -1 where it is unknown: without a base span, but a repeat of one. Features are -1 where they
    are withheld: those of the form, of half of the base spans that repeat another base span."""
    schema = arrow_schema(_GRAPHS)

    def run(batches):
        for batch in slices(batches):
            labels, rows, links, at = [], [], [], 0
            for text in texts_of(batch):
                nodes = mentions(text, base_spans(text)) if _MAY_HOLD.search(text) else []
                found = edges(text, nodes) if nodes else []
                own = [m[2] for m in nodes]
                given = [features(text, m) for m in nodes]
                for i, j, k in found:
                    if k != CHAIN:
                        if (nodes[i][2] > 0) != (nodes[j][2] > 0):
                            own[i if not nodes[i][2] else j] = -1
                        elif nodes[i][2]:
                            for x in (i, j):
                                if zlib.crc32(f"{x}|{text[nodes[x][0] : nodes[x][1]]}".encode("utf-8", "surrogatepass")) & 1:
                                    given[x][: FEATURES - 2] = [-1] * (FEATURES - 2)
                labels += own
                rows += given
                links += [(i + at, j + at, k) for i, j, k in found]
                at += len(nodes)
            if at:
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(x, dtype=t).tobytes()], pa.binary()) for x, t in ((labels, "i1"), (rows, "<i4"), (links, "<i4"))], schema=schema)

    return written(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, _GRAPHS), "mentions")


class Field:
    """Potentials in logs: unary[bucket, label] and pair[kind of edge, label of the earlier, of the later]."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def of(self, found: list[int]) -> np.ndarray:
        return self.unary[found].sum(axis=0)

    def marginals(self, unary: np.ndarray, links: list[tuple[int, int, np.ndarray]], rounds: int | None = None, damp: float = 0.3, settled: float = 1e-3) -> np.ndarray:
        """Beliefs by sum-product messages in logs, both ways along each link, until no message moves by more
        than settled, or for `rounds` rounds. Without rounds they have time to cross the whole graph, and
        are damped more from the fiftieth on, so that a loop that swings comes to rest."""
        out = unary.copy()
        if links:
            a, b = np.asarray([(i, j) for i, j, _ in links]).T
            to, source = np.concatenate([b, a]), np.concatenate([a, b])
            pot = np.stack([p for *_, p in links] + [p.T for *_, p in links])
            m, n = np.zeros((len(to), unary.shape[1])), len(links)
            back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
            for k in range(2 * len(unary) + 60 if rounds is None else rounds):
                belief = unary.copy()
                np.add.at(belief, to, m)
                into = belief[source] - m[back]
                new = np.logaddexp.reduce(into[:, :, None] + pot, axis=1)
                new -= np.logaddexp.reduce(new, axis=1)[:, None]
                keep = damp if rounds is not None or k < 50 else max(damp, 0.7)
                moved = (1 - keep) * np.abs(new - m).max()
                m = keep * m + (1 - keep) * new
                if rounds is None and moved <= settled:
                    break
            np.add.at(out, to, m)
        out = out - np.logaddexp.reduce(out, axis=1)[:, None]
        return np.exp(out)

    def added(self, text: str, base: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int]]:
        """Mentions without a base span whose most likely label is personal data, at probability least; of
        equally likely labels the first of LABELS counts."""
        nodes = mentions(text, base)
        if not any(m[2] == 0 for m in nodes):
            return []
        unary = np.stack([self.of(features(text, m)) for m in nodes])
        for i, m in enumerate(nodes):
            if m[2]:  # a base span's label is known
                unary[i] = np.where(np.arange(len(LABELS)) == m[2], 0.0, -30.0)
        belief = self.marginals(unary, [(i, j, self.pair[k]) for i, j, k in edges(text, nodes)])
        return [(s, e, int(p.argmax()) - 1) for (s, e, k), p in zip(nodes, belief) if not k and p.argmax() and p.max() >= least]


_SIZE = BUCKETS * len(LABELS), 3 * len(LABELS) ** 2


def told(labels: np.ndarray) -> np.ndarray:
    """Beliefs of known labels; a row of zeros where a label is unknown, so that it says and costs nothing."""
    return np.eye(len(LABELS))[np.maximum(labels, 0)] * (labels >= 0)[:, None]


def conditionals(belief: np.ndarray, given: np.ndarray, links: np.ndarray, w: np.ndarray) -> np.ndarray:
    """log P(label of each mention | features, what its neighbours are believed to be)."""
    size = len(LABELS)
    unary, pair = w[: _SIZE[0]].reshape(-1, size), w[_SIZE[0] :].reshape(3, size, size)
    z = (unary[given] * (given >= 0)[:, :, None]).sum(axis=1)
    for k in range(3):
        i, j = links[links[:, 2] == k, :2].T
        np.add.at(z, i, belief[j] @ pair[k].T)
        np.add.at(z, j, belief[i] @ pair[k])
    return z - np.logaddexp.reduce(z, axis=1)[:, None]


def slope(belief: np.ndarray, given: np.ndarray, links: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log pseudo-likelihood of the beliefs, and its gradient by every potential."""
    z = conditionals(belief, given, links, w)
    off = belief.sum(axis=1, keepdims=True) * np.exp(z) - belief
    g_unary, g_pair = np.zeros((BUCKETS, len(LABELS))), np.zeros((3, len(LABELS), len(LABELS)))
    for f in range(given.shape[1]):
        seen = given[:, f] >= 0
        np.add.at(g_unary, given[seen, f], off[seen])
    for k in range(3):
        i, j = links[links[:, 2] == k, :2].T
        g_pair[k] = off[i].T @ belief[j] + belief[i].T @ off[j]
    return -float((belief * z).sum()), np.concatenate([g_unary.reshape(-1), g_pair.reshape(-1)])


def minimum(f, w: np.ndarray, passes: int, near: float = 1e-4, memory: int = 8) -> np.ndarray:
    """Quasi-Newton descent (limited memory) with halved steps; f gives value and gradient, at most passes times."""
    value, g = f(w)
    steps, spent = [], 1
    while spent < passes and np.abs(g).max() > near * max(1.0, abs(value)):
        d, held = -g, []
        for s, y in reversed(steps):
            held.append((s @ d) / (s @ y))
            d = d - held[-1] * y
        if steps:
            s, y = steps[-1]
            d = d * (s @ y) / (y @ y)
        else:
            d = d / max(1.0, np.abs(g).max())
        for (s, y), a in zip(steps, reversed(held)):
            d = d + (a - (y @ d) / (s @ y)) * s
        size = 1.0
        while True:
            new, new_g = f(w + size * d)
            spent += 1
            if new <= value + 1e-4 * size * (g @ d) or spent >= passes:
                break
            size /= 2
        if new > value:
            break
        s, y = size * d, new_g - g
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y)]
        w, value, g = w + s, new, new_g
    return w


def learn(docs: DataFrame, agreement: float = 6.0, ridge: float = 1.0, rounds: int = 3, passes: int = 14) -> Field:
    """The field of docs(text), fitted on all documents in `rounds` rounds of at most `passes` passes over mentions.

    Mentions of unknown label count as what the round before believes of them, at first what the prior does
    (expectation maximisation). In each pass the executors sum the gradient; the driver
    gets at most one number for each potential (BUCKETS * 5 + 75). ridge is the strength of the prior: potentials
    are near 0, but for those of skip edges between equal kinds, near `agreement`. Without mentions the
    potentials are the prior's."""
    spark, schema, size = docs.sparkSession, arrow_schema("cell int, v double"), len(LABELS)
    table = graphs(docs)
    middle = np.zeros(sum(_SIZE))
    middle[_SIZE[0] :].reshape(3, size, size)[[SAME, SIMILAR]] += agreement * np.diag([0.0, 1, 1, 1, 1])

    def among(before: np.ndarray):
        def f(w: np.ndarray) -> tuple[float, np.ndarray]:
            shared = spark.sparkContext.broadcast((w, before))

            def run(batches):
                now, then = shared.value
                value, g = 0.0, np.zeros(len(now))
                for batch in slices(batches, "features"):
                    for labels, given, links in zip(*(batch.column(c).to_pylist() for c in ("labels", "features", "edges"))):
                        labels, given, links = np.frombuffer(labels, "i1").astype(int), np.frombuffer(given, "<i4").reshape(-1, FEATURES), np.frombuffer(links, "<i4").reshape(-1, 3)
                        belief = told(labels)
                        for _ in range(6):  # unknown labels tell one another
                            belief[labels < 0] = np.exp(conditionals(belief, given, links, then))[labels < 0]
                        v, own = slope(belief, given, links, now)
                        value, g = value + v, g + own
                at = np.flatnonzero(g)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(g[at], value))], schema=schema)

            out, value = ridge * (w - middle), 0.5 * ridge * float((w - middle) @ (w - middle))
            summed = table.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
            shared.unpersist()
            cells, v = summed.column("cell").to_numpy(), summed.column("v").to_numpy()
            np.add.at(out, cells[cells >= 0], v[cells >= 0])
            pairs = out[_SIZE[0] :].reshape(3, size, size)
            for k in (SAME, SIMILAR):  # repeats have no order
                pairs[k] = (pairs[k] + pairs[k].T) / 2
            return value + float(v[cells < 0].sum()), out

        return f

    w = middle
    for _ in range(rounds):
        w = minimum(among(w), w.copy(), passes)
    return Field(w[: _SIZE[0]].reshape(-1, size), w[_SIZE[0] :].reshape(3, size, size))


def written_spans(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, field: Field, least: float = 0.9) -> DataFrame:
    """Personal data in every row of docs(doc_id, text): base counts and digest, and all spans.

    Offsets count code points, ends are exclusive. A null or empty text has no span (an empty string, and
    the digest of one). A text of any length is looked at whole. An empty table gives no rows. Repeated rows give repeated rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    schema = arrow_schema(_FOUND)

    def run(batches):
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in slices(batches):
            rows = []
            for text in texts_of(batch):
                base = base_spans(text)
                more = shared.value.added(text, base, least) if _MAY_HOLD.search(text) else []
                digest = hashlib.sha256(written_spans(base).encode()).hexdigest() if base else nothing
                rows.append((*(sum(k == j for *_, k in base) for j in range(4)), digest, written_spans(base + more)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, schema.types[1:]))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _FOUND)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span as its kind in brackets; spans that overlap become one, of the first kind."""
    out, at = [], 0
    for s, e, k in sorted(spans, key=lambda x: (x[0], x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, field: Field, least: float = 0.9) -> DataFrame:
    """docs with the personal data of its text replaced; all columns stay, null texts stay null.

    A column n_chars, where there is one, is counted anew."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in slices(batches):
            texts = []
            for text in batch.column("text").to_pylist():
                if text and _MAY_HOLD.search(text):
                    base = base_spans(text)
                    text = redacted(text, base + shared.value.added(text, base, least))
                texts.append(text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
