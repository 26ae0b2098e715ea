"""Per-document text quality statistics (problem 10).

Method: every segment of a text (a run of lines of one layout) gives a distribution over function words,
other words, numbers, sentence ends, separators, item marks and other signs. Its Jensen-Shannon
divergence to the prose profiles of its language and to profiles of lists, tables and junk decides what it
is; basic counts are taken alongside. Texts are read once: the distributions of their segments are written to
the shared folder, the prose profiles of each language are fitted to all of them, from general ones, and then
each document's segments are compared to the profiles. There is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.plans.stage import staged

#: Function words of each language. Fixed values.
FUNCTION_WORDS = {
    "en": """a about after again all although an and another any are as at be because been before but by can could did do does down each
        even every for from had has have he her here him his how i if in into is it its just me more most my no nobody not nothing of off on
        once one only or other our out over she should since so some still than that the their them then there these they this
        those through to today too two twice until up us was we well were what when where which while who why will with without
        would yet you your""",
    "es": """a al algo antes aunque bajo cada como con contra cuando de del desde después donde el ella ellos en entre era es esa ese
        eso esta estaba este esto fue ha han hasta hay la las le les lo los más me mi mientras muy ni no nos o otra otro para pero por
        porque qué que quien se si sin sobre son su sus también tan te tu un una y ya yo""",
    "de": """aber alle als am an auch auf aus bei bis da damit das dass dem den denn der des die dir doch durch ein eine einem einen
        einer eines er es für hab habe haben hat ich ihr im in ist ja je kann kein man mehr mein mich mir mit nach nicht nichts
        noch nun nur ob oder ohne sehr sein sich sie sind so über um und uns unser unter vom von vor wann war was weil wenn wer wie wir
        wird wo zu zum zur""",
    "fr": """à après au aussi aux avant avec bien ce cela ces cet cette chez comme dans de des deux donc du elle en encore enfin
        entre est et était être eu fait fois ici il ils je la là le les leur lui ma mais me même mes moi mon ne nos notre nous on
        ou où par pas plus pour qu quand que qui sa sans se ses si son sont sous sur ta te tes toi ton tout très tu un une vos vous y""",
}
_LANGUAGES = list(FUNCTION_WORDS)
_MASK: dict[str, int] = {}
for _i, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words.split():
        _MASK[_w] = _MASK.get(_w, 0) | 1 << _i

#: Shares of [function words, other words, numbers, sentence ends, separators, item marks, other signs]. Fixed values.
PROFILES = {
    "prose": ("prose", [0.40, 0.46, 0.015, 0.075, 0.04, 0.003, 0.007]),
    "prose, few function words": ("prose", [0.27, 0.57, 0.02, 0.08, 0.05, 0.003, 0.007]),
    "prose without punctuation": ("prose", [0.44, 0.53, 0.015, 0.003, 0.003, 0.003, 0.006]),
    "dialogue": ("prose", [0.37, 0.42, 0.015, 0.08, 0.035, 0.003, 0.077]),
    "list": ("list", [0.25, 0.48, 0.03, 0.01, 0.05, 0.17, 0.01]),
    "list of names": ("list", [0.08, 0.60, 0.02, 0.01, 0.08, 0.20, 0.01]),
    "table": ("table", [0.14, 0.40, 0.13, 0.005, 0.22, 0.10, 0.005]),
    "numbers": ("table", [0.01, 0.05, 0.70, 0.01, 0.08, 0.12, 0.03]),
    "keywords": ("junk", [0.03, 0.93, 0.01, 0.005, 0.005, 0.01, 0.01]),
    "damaged": ("junk", [0.12, 0.38, 0.02, 0.03, 0.03, 0.005, 0.415]),
    "signs": ("junk", [0.01, 0.10, 0.03, 0.01, 0.02, 0.03, 0.80]),
}
_NAMES = list(PROFILES)
_KINDS = [k for k, _ in PROFILES.values()]
_P = np.array([p for _, p in PROFILES.values()])
_P = _P / _P.sum(1, keepdims=True)

_PROSE = [i for i, k in enumerate(_KINDS) if k == "prose"]

#: So many segments a general profile counts for where the prose profiles of the languages are fitted.
PRIOR = 50


class Profiles:
    """The profiles segments are compared to: those of lists, tables and junk, and each language's own of prose."""

    def __init__(self, sums: np.ndarray | None = None):
        """sums: by language and profile of prose, the number of segments near to it and the sum of their distributions."""
        self.names = [n for n in _NAMES if PROFILES[n][0] != "prose"]
        self.kinds = [PROFILES[n][0] for n in self.names]
        self.language = [-1] * len(self.names)
        rows = [_P[_NAMES.index(n)] for n in self.names]
        for k, language in enumerate(_LANGUAGES):
            for j, i in enumerate(_PROSE):
                n, total = (sums[k, j, 0], sums[k, j, 1:]) if sums is not None else (0.0, 0.0)
                rows.append((total + PRIOR * _P[i]) / (n + PRIOR))
                self.names.append(f"{_NAMES[i]}, {language}")
                self.kinds.append("prose")
                self.language.append(k)
        self.p = np.array(rows)
        self.p /= self.p.sum(1, keepdims=True)

    def nearest(self, v: np.ndarray, language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest profile of each distribution, of those for all and its language's, and its divergence."""
        of = np.array(self.language)
        far = np.where((of == -1) | (of == language[:, None]), divergence(v, self.p), np.inf)
        best = far.argmin(1)
        return best, far[np.arange(len(v)), best]


_CUE = re.compile(r"^\s*(?:[\[(]\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?[\])]|\d{1,2}:\d{2}:\d{2}[.,]\d{3}\s*-->.*$|>+(?=\s))\s*")
_MARK = re.compile(r"^\s*(?:\d{1,4}[.)]|[a-zA-Z][.)]|[-*•▪◦‣+·]|\[[ xX]?\]|#\d+|\d{1,3}:\d{2}(?::\d{2})?)\s+(?=\S)")
_FIELD = re.compile(r"^\s*\w[\w ]{0,20}: \S")
_GAP = re.compile(r"\S {3,}(?=\S)")
_END = re.compile(r"[.!?…]['\")»”\]]*$")
_TOKEN = re.compile(r"^[(\"'“”„«»¿¡\[*_–—-]*([^\W\d_]+(?:['’.&-][^\W\d_]+)*)['\")”“»\]*_]*([.,;:!?…]*)['\")”»\]*_]*$")
_NUMBER = re.compile(r"^[(\"'\[]*[+-]?\d+(?:[.,:/x-]\d+)*%?[)\"'\]]*([.,;:!?…]*)['\")\]]*$")
_WORDS = re.compile(r"[^\W\d_]+")
_INLINE = re.compile(r"(?:[,;]|\s[/|·•–-]) (?=[\"'(“]?[A-ZÀ-Ý0-9])")
_SIGN = re.compile(r"[^\w\s]|_")
_VOWEL = re.compile(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüœ]|[^\x00-ɏ]", re.I)

# a token's code: its kind, its languages if it is a function word, and what ends it
_WORD_KIND, _NUMBER_KIND, _OTHER_KIND = 0, 16, 17
_CODES: dict[str, int] = {}


def _code(token: str) -> int:
    m = _TOKEN.match(token)
    if m:
        word = m[1].lower()
        kind = _MASK.get(word, 0) or _MASK.get(word.split("'")[0].split("’")[0], 0)
        if not kind and len(word) > 2 and not _VOWEL.search(word):
            kind = _OTHER_KIND
        tail = m[2]
    elif m := _NUMBER.match(token):
        kind, tail = _NUMBER_KIND, m[1]
    else:
        pieces = _WORDS.findall(token)
        signs = sum(not (ch.isalnum() or ch in ",;:|.'\"-–—/()!?&") for ch in token)
        table = "," in token or ";" in token or "|" in token
        kind, tail = (_WORD_KIND if table and pieces and not signs and len(token) < 40 else _OTHER_KIND), token[-1]
        if token in ("|", ";", ",", "/", "||", "-", "–", "—", "·"):
            return 36 + 18 + _OTHER_KIND  # a separator of its own
        if kind == _WORD_KIND:
            return kind + 18 * 2
    end = 1 if tail[-1:] in (".", "!", "?", "…") and tail else 2 if tail else 0
    return kind + 18 * end


def _codes(tokens: list[str]) -> list[int]:
    out = list(map(_CODES.get, tokens))
    if None in out:
        if len(_CODES) > 400_000:
            _CODES.clear()
        for i, c in enumerate(out):
            if c is None:
                out[i] = _CODES[tokens[i]] = _code(tokens[i])
    return out


#: Which kinds of token are function words of each language.
_BY_LANGUAGE = np.array([[m >> i & 1 if 0 < m < 16 else 0 for m in range(18)] for i in range(len(_LANGUAGES))])


def _line_kind(line: str) -> str:
    """marked (an item, a row, a field) or text."""
    if not line.strip(" +-=|_*#~"):
        return "rule"
    if m := _MARK.match(line):
        words = line[m.end() :].split()
        return "text" if len(words) >= 8 and _END.search(line) and line.lstrip()[:1] in "-*•" else "item"
    if line.count("|") >= 2 or line.count("\t") >= 2 or len(_GAP.findall(line)) >= 2:
        return "row"
    words = line.split()
    if len(words) <= 14 and not _END.search(line):
        if _FIELD.match(line):
            return "row"
        if line.count(";") >= 2 or line.count(",") >= 3 and line.count(", ") <= 1:
            return "row"
    return "text"


def _segments(text: str) -> Iterator[tuple[int, list[str], str]]:
    """(characters, lines, kind) of every run of lines of one kind within a paragraph."""
    run: list[str] = []
    kind = ""
    for line in text.splitlines():
        line = _CUE.sub("", line)
        k = _line_kind(line) if line.strip() else ""
        if k == "rule":
            k = kind if kind == "row" else "row"
        if k != kind and run:
            yield sum(map(len, run)), run, kind
            run = []
        kind = k
        if k:
            run.append(line)
    if run:
        yield sum(map(len, run)), run, kind


def _distribution(lines: list[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The distribution of a segment, and how many function words of each language it has."""
    tokens = " ".join(lines).split()
    codes = np.bincount(_codes(tokens), minlength=72)[:72].reshape(4, 18)
    kinds = codes[:3].sum(0)
    by_language = _BY_LANGUAGE @ kinds
    function = int(by_language.max())
    words = int(kinds[:16].sum()) - function
    ends, separators = int(codes[1].sum()), int(codes[2].sum()) + int(codes[3].sum())
    other = int(kinds[17])
    marks = 0.0
    if kind == "item":
        marks = len(lines)
        ends = max(0, ends - sum(1 for x in lines if _END.search(x)))  # an item's own end is no sentence end
    elif kind == "row":
        marks = 0.5 * len(lines)
        separators += sum(x.count("|") + x.count("\t") + len(_GAP.findall(x)) + (x.count(",") + x.count(";") if " " in x else 0) for x in lines)
    else:
        # a line that breaks off without an end before one that begins anew is an item, if lines are short
        starts = [x.lstrip("\"'“«(–—- ")[:1] for x in lines]
        for i, x in enumerate(lines):
            anew = i + 1 == len(lines) or starts[i + 1].isupper() or starts[i + 1].isdigit()
            if anew and not _END.search(x) and len(x.split()) <= 11 and not x.isupper():
                marks += 1
        if marks and (marks < 0.6 * len(lines) or len(lines) < 3 and len(tokens) >= 8):
            marks = 0.0
        # items in a row: a separator before every few words, each item beginning anew, and next to no sentence end
        items = sum(len(_INLINE.findall(x)) for x in lines)
        if items >= 3 and len(tokens) <= 10 * items and ends * 40 <= len(tokens):
            marks = max(marks, float(items))
    if len(tokens) >= 12 and function < 0.15 * len(tokens) and len({t.lower() for t in tokens}) < 0.4 * len(tokens):
        other += words // 2  # few words over and over
        words -= words // 2
    p = np.array([function, words, kinds[16], ends, separators, marks, other], float)
    return p / max(p.sum(), 1.0), by_language


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of every row of p to every row of q."""
    a, b = p[:, None, :], q[None, :, :]
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(a > 0, a * np.log2(a / m), 0.0).sum(2)
        right = np.where(b > 0, b * np.log2(b / m), 0.0).sum(2)
    return (left + right) / 2


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("mean_word_length", pa.float64()), ("symbol_ratio", pa.float64()), ("ended_lines", pa.float64()), ("function_words", pa.float64())]
    + [(f"{k}_share", pa.float64()) for k in ("prose", "list", "table", "junk")]
    + [("profile", pa.string()), ("profile_divergence", pa.float64())]
)
STATISTICS = "doc_id long, n_words long, mean_word_length double, symbol_ratio double, ended_lines double, function_words double, prose_share double, list_share double, table_share double, junk_share double, profile string, profile_divergence double"


_MEASURED = pa.schema(
    list(_OUT)[:6] + [("size", pa.list_(pa.int64())), ("vectors", pa.list_(pa.float64())), ("spoken", pa.list_(pa.int32()))]
)
_MEASURED_DDL = ", ".join(STATISTICS.split(", ")[:6]) + ", size array<long>, vectors array<double>, spoken array<int>"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> the basic counts, and of every segment its characters, its distribution and how many function words of each language it has."""
    for b in batches:
        basic, sizes, vectors, spoken = [], [], [], []
        for text in b.column(1).to_pylist():
            text = text or ""
            words = _WORDS.findall(text.lower())
            lines = [x for x in text.splitlines() if x.strip()]
            chars = sum(map(len, words))
            functions = sum(map(_MASK.__contains__, words))
            basic.append((len(words), chars / max(1, len(words)), len(_SIGN.findall(text)) / max(1, len(text)), sum(1 for x in lines if _END.search(x)) / max(1, len(lines)), functions / max(1, len(words))))
            found = [(n, *_distribution(run, kind)) for n, run, kind in _segments(text)]
            sizes.append([n for n, _, _ in found])
            vectors.append(np.concatenate([v for _, v, _ in found]) if found else [])
            spoken.append(np.concatenate([of for _, _, of in found]) if found else [])
        columns = [b.column(0), *(pa.array([x[i] for x in basic], f.type) for i, f in enumerate(list(_MEASURED)[1:6]))]
        columns += [pa.array(x, f.type) for x, f in zip((sizes, vectors, spoken), list(_MEASURED)[6:])]
        yield pa.RecordBatch.from_arrays(columns, schema=_MEASURED)


def _of_segments(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, characters, distribution and function words by language of every segment of a batch."""
    size = b.column("size")
    owner = np.repeat(np.arange(b.num_rows), size.value_lengths().to_numpy(zero_copy_only=False))
    return owner, size.flatten().to_numpy(), b.column("vectors").flatten().to_numpy().reshape(-1, 7), b.column("spoken").flatten().to_numpy().reshape(-1, len(_LANGUAGES))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By language and profile of prose: the number of segments near to it and the sum of their distributions."""
    sums, general = np.zeros((len(_LANGUAGES), len(_PROSE), 8)), Profiles()
    for b in batches:
        _, _, v, spoken = _of_segments(b)
        if len(v):
            language = spoken.argmax(1)
            best, _ = general.nearest(v, language)
            first = len(general.names) - len(_LANGUAGES) * len(_PROSE)
            prose = best >= first
            np.add.at(sums, (language[prose], (best[prose] - first) % len(_PROSE)), np.concatenate([np.ones((int(prose.sum()), 1)), v[prose]], axis=1))
    yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])


def _fitted(measured: DataFrame) -> Profiles:
    got = [np.frombuffer(r[0], float) for r in measured.select("size", "vectors", "spoken").mapInArrow(_sums, "sums binary").collect()]
    return Profiles(np.sum(got, axis=0).reshape(len(_LANGUAGES), len(_PROSE), 8) if got else None)


def fitted_profiles(documents: DataFrame, sample: int | None = None) -> Profiles:
    """Profiles fitted to all documents, or to about `sample` where a caller asks for that; what reaches the driver is sums of fixed size."""
    every = max(1, documents.count() // sample) if sample else 1
    some = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0) if every > 1 else documents
    return _fitted(some.select("doc_id", "text").mapInArrow(_measured, _MEASURED_DDL))


def _statistics(profiles: Profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(batches, profiles)

    return run


def _rows(batches: Iterator[pa.RecordBatch], profiles: Profiles) -> Iterator[pa.RecordBatch]:
    kinds = ["prose", "list", "table", "junk"]
    kind_of = np.array([kinds.index(k) for k in profiles.kinds])
    for b in batches:
        own, size, v, spoken = _of_segments(b)
        n, sizes = b.num_rows, size.astype(float)
        shares = np.zeros((n, 4))
        whole, words_of = np.zeros((n, 7)), np.zeros((n, len(_LANGUAGES)))
        if len(v):
            np.add.at(words_of, own, spoken)
            nearest, _ = profiles.nearest(v, words_of[own].argmax(1))
            np.add.at(shares, (own, kind_of[nearest]), sizes)
            np.add.at(whole, own, v * sizes[:, None])
        total = shares.sum(1)
        shares = shares / np.maximum(total, 1e-12)[:, None]
        best, far = profiles.nearest(whole / np.maximum(whole.sum(1, keepdims=True), 1e-12), words_of.argmax(1))
        columns = [b.column(i) for i in range(6)] + [pa.array(shares[:, i]) for i in range(4)]
        columns += [pa.array([profiles.names[k] if t else None for k, t in zip(best, total)], pa.string()), pa.array([float(far[i]) if total[i] else None for i in range(n)], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, schema=_OUT)


def text_statistics(documents: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """The statistics of every document, one row each.

    n_words; mean_word_length; symbol_ratio (characters that are no letter, digit or white space);
    ended_lines (share of lines with a sentence end); function_words (share of words); the shares of the
    characters that are prose, list, table or junk; the profile nearest to the whole text, and its
    divergence. The language of a text is that of most of its function words. A null, empty or blank text
    has zeros and a null profile; repeated rows stay. `profiles`: fitted to the documents where not given.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = documents.mapInArrow(_measured, _MEASURED_DDL)
    if profiles is None:
        measured = staged(measured, "segments")  # read twice below
        profiles = _fitted(measured)
    return measured.mapInArrow(_statistics(profiles), STATISTICS)


def not_prose(documents: DataFrame) -> DataFrame:
    """doc_id of every document of whose characters more than half are no prose."""
    return text_statistics(documents).where("list_share + table_share + junk_share > 0.5").select("doc_id")
