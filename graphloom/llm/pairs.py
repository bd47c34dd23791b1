"""Problem 4: question and answer pairs whose answer is of no use, with what is wrong."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text_json import instant
from graphloom.llm.languages import LANGUAGES, NAMES, labelled
from graphloom.llm.text import chunks, each_sentence, ngrams, prose, prose_words, sentences, visible, without_code

#: Character n-grams of the naive Bayes model, and the hash buckets that they share.
SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: Both languages must be as likely as this, from texts with so many letters.
SURE = 0.9
LEAST_LETTERS = 11
#: The end-of-text model: characters and character classes of a context, hash buckets of each, and how many times over a
#: longer context must be seen to count as much as the shorter one. A text whose end is less likely than this breaks off.
END_CHARS, END_BUCKETS = 6, 1 << 22
END_CLASSES, CLASS_BUCKETS = (1, 2, 6), 1 << 16
BACK_OFF = 4.0
LIKELY_END = 0.045
LEAST_SEEN, NAME_SEEN = 3, 12
#: Share of the question's words that a copy gives back in one piece, and of other words that it may have (three at least).
COPIED_WORDS = 0.7
OTHER_WORDS = 0.3

#: Answers that stand for no answer, after marks, tags and fences are taken off.
PLACEHOLDERS = frozenset(("null", "none", "nil", "n a", "na", "nan", "todo", "tbd", "tba", "fixme", "undefined", "unknown", "placeholder", "lorem ipsum", "xxx", "no answer", "not available", "keine antwort", "sans réponse", "sin respuesta"))
_REQUEST_NAMES = {
    "en": "englisch anglais inglés ingles inglese inglês engels",
    "de": "allemand alemán aleman tedesco alemão alemao duits",
    "fr": "französisch francés frances francese francês frans",
    "es": "spanisch espagnol spagnolo espanhol spaans",
    "it": "italienisch italien italiaans",
    "pt": "portugiesisch portugais portugués portoghese portugees",
    "nl": "niederländisch néerlandais neerlandés olandese holandês",
    "pl": "polnisch polonais polaco polacco pools",
    "ru": "russisch russe ruso russo",
    "ja": "japanisch japonais japonés giapponese japonês japans",
}
_REQUESTED = {name: code for code, names in NAMES.items() for name in (*names, *_REQUEST_NAMES[code].split()) if len(name) > 3 or not name.isascii()}
#: How the languages decline, in the first person or of the request.
_DECLINES = (
    r"\bi (?:can't|cannot|can not|could not|won't|will not|must not|may not|do not wish to|don't wish to|refuse to|decline to|must decline|have to decline)\b|\bi(?:'m| am) (?:not (?:able|allowed|permitted|in a position|comfortable|authori[sz]ed)|unable)\b",
    r"\bi(?: would|'d) (?:rather|prefer) not\b|\bi prefer not\b|\bnot something i (?:can|may|am)\b|\bbeyond what i\b|\boutside (?:of )?what i\b|\bwhat i(?:'m| am) allowed\b",
    r"\b(?:ich|wir)\b.*\b(?:nicht in der lage|kann|darf|möchte|werde)\b.*\b(?:nicht|keine?n?)\b|\b(?:kann|darf|möchte|werde) (?:ich|wir)\b.*\b(?:nicht|keine?n?)\b|\bich bin nicht (?:in der lage|befugt|berechtigt)\b|\bich muss .*ablehnen\b|\bich .*lieber nicht\b",
    r"\bje (?:ne )?(?:peux|puis|suis|pourrai|souhaite|veux|dois)\b.*\b(?:pas|refuser|décliner)\b|\bje préfère ne pas\b|\bil m'est impossible\b|\bj'ai le droit\b|\bje refuse\b",
    r"\bno (?:puedo|podré|debo|quiero|estoy autorizad[oa])\b|\bno me es posible\b|\bprefiero no\b|\bme temo que no\b|\bqueda fuera de\b|\bse me permite\b|\bdebo (?:rechazar|declinar|negarme)\b|\bme niego\b",
    r"\bnon (?:posso|potrò|sono in grado|sono autorizzat[oa]|mi è possibile|mi è permesso|voglio)\b|\bpreferisco non\b|\bpreferirei non\b|\bdevo (?:rifiutare|declinare)\b|\besula da\b|\bmi è consentito\b",
    r"\bnão (?:posso|poderei|devo|quero|estou autorizad[oa]|consigo|me é possível|me é permitido)\b|\bprefiro não\b|\bfora do que (?:me é|posso)\b|\bque me é permitido\b|\btenho de (?:recusar|declinar)\b",
    r"\bik (?:kan|mag|wil|ben)\b.*\b(?:niet|geen)\b|\bik .*liever niet\b|\bnie (?:mogę|wolno mi|jestem w stanie)\b|\bwolę nie\b|\bя не (?:могу|буду|имею права)\b|\bне могу\b|(?:できません|いたしかねます|お答えしかねます|控えさせていただきます)",
)
_DECLINE = re.compile("|".join(_DECLINES), re.S)
#: Stems of what is declined, the request or an answer to it, and of what goes with it. A sentence that declines
#: something else, such as a default or a change, is an answer.
_SERVICE = re.compile(
    r"answer|question|request|help|assist|inform|detail|discuss|comment|topic|subject|matter|repository|provide|share|respond|opinion|say|do|"
    r"antwort|frage|anfrage|helfen|hilfe|auskunft|bearbeit|thema|sach|angabe|äußer|dazu|dabei|"
    r"répon|question|demande|aider|aide|point|sujet|prononc|renseign|faire|respon|pregunt|petici|solicit|ayud|asunt|tema|opin|inform|hac|permit|permet|allowed|droit|"
    r"rispo|domand|richiest|aiut|argoment|espri|fare|pergunt|pedid|ajud|assunt|pronunci|fazer|"
    r"vraag|verzoek|antwoord|help|onderwerp|pyta|odpowi|pomóc|pomoc|prośb|temat|вопрос|ответ|помо|запрос|тем|質問|回答|お答え|依頼|手伝|お手|支援"
)
_REASON = re.compile(r"\b(?:because|since|weil|denn|da|parce que|puisque|car|porque|ya que|perché|poiché|pois|omdat|want|ponieważ|bo|потому|так как)\b|ので|ため")
_SPECIFIC = re.compile(r"\d|`|\w[._/:]\w|\w\(\)|[a-z][A-Z]")
#: Words of four letters and more, besides what declines and what is declined, that a refusal may have.
OTHER_CONTENT = 3
_TURNING = re.compile(r"(?:^|[,;:–—-]\s*|\s)(?:but|however|still|instead i|yet|aber|doch|jedoch|mais|cependant|pero|sin embargo|ma|però|tuttavia|mas|porém|maar|ale|lecz|но|однако)\b[^,]*\S")
_COURTESY = re.compile(r"\b(?:sorry|apolog\w+|unfortunately|please|thank\w*|ask a maintainer|leid|leider|bitte|desolé|désolé\w*|malheureusement|siento|lamentablemente|disculp\w+|perd[oó]n\w*|mi dispiace|purtroppo|spiacente|desculp\w+|lamento|infelizmente|helaas|excuses|przepraszam|niestety|извините|к сожалению|申し訳)\b")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_LIST = re.compile(r"^\s*(?:[-*+•–]|\d+[.)])(?:\s+|$)")
_WORD = re.compile(r"[^\W_]+")
_BLANKED = {code: " " for code in range(128) if not chr(code).isalnum()}


def _words(text: str) -> list[str]:
    if text.isascii():
        return text.lower().translate(_BLANKED).split()
    return _WORD.findall(unicodedata.normalize("NFKC", visible(text)).casefold())


def is_empty(answer: str | None) -> bool:
    """Null, blank, only marks, tags or fences, or only a phrase that stands for no answer."""
    return answer is None or not (words := _words(_TAG.sub(" ", answer) if "<" in answer else answer)) or " ".join(words) in PLACEHOLDERS


def is_copy(question: str, answer: str) -> bool:
    """Whether the answer is nearly all of the question, once or more often, and hardly a word besides."""
    asked, left = _words(question), _words(answer)
    slack = max(3, int(OTHER_WORDS * len(asked)))
    known = set(asked)
    if not asked or len(left) < COPIED_WORDS * len(asked) or sum(w not in known for w in left) > slack:
        return False
    whole = f" {' '.join(left)} ".replace(" ", "  ").replace(f" {'  '.join(asked)} ", " ")
    covered = len(asked) if len(whole.split()) < len(left) else 0
    left = whole.split()
    while len(left) > slack or not covered:
        match = difflib.SequenceMatcher(None, asked, left, autojunk=False).find_longest_match()
        if match.size < max(1, COPIED_WORDS / 2 * len(asked)):
            break
        covered = max(covered, match.size)
        left = left[: match.b] + left[match.b + match.size :]
    return covered >= COPIED_WORDS * len(asked) and len(left) <= slack


def _without(text: str, part: str) -> str:
    """``text`` with a line end for each ``part``, in any case."""
    lower, wanted = text.lower(), part.lower()
    if not wanted or len(lower) != len(text):
        return text.replace(part, "\n") if part else text
    pieces, start = [], 0
    while (at := lower.find(wanted, start)) >= 0:
        pieces.append(text[start:at])
        start = at + len(wanted)
    return "\n".join([*pieces, text[start:]])


def _declines(piece: str) -> bool:
    """Whether a sentence declines the request and says nothing else: no reason, no number or name, hardly a word of content."""
    lower = piece.lower()
    if _SPECIFIC.search(piece if not piece.isupper() else lower) or not _SERVICE.search(lower) or not _DECLINE.search(lower) or _REASON.search(lower):
        return False
    if _TURNING.search(lower) and not _COURTESY.search(lower):
        return False
    rest = _COURTESY.sub(" ", _DECLINE.sub(" ", lower))
    return sum(len(w) >= 4 and not _SERVICE.search(w) for w in _words(rest)) <= OTHER_CONTENT


def is_refusal(question: str, answer: str) -> bool:
    """Whether every sentence but the question's own declines or is a courtesy, and at least one declines; code, lists
    and turns to an answer do not."""
    if "```" in answer:
        return False
    declined = False
    for line in _without(visible(answer), visible(question).strip()).replace("’", "'").splitlines():
        if _LIST.match(line):
            return False
        for piece in each_sentence(line):
            if not _words(piece):
                continue
            if _declines(piece):
                declined = True
            elif not _COURTESY.search(piece.lower()):
                return False
    return declined


#: Classes of the characters: the characters themselves, but one of each kind of letters and of digits.
_KIND = np.arange(1 << 16, dtype=np.uint32)
_KIND[97:123] = _KIND[0xC0:0x2000] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48
_KIND[0x3040:0xA000] = 0x3040


def _end_contexts(texts: list[str], last_only: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the contexts at each character (or only the last) of ``texts``, from short to long; whether the text ends
    there; and whether names may stand there: in list items, code spans and texts without a blank.

    A context is a state and the last characters: their classes, few and more, then the characters themselves. The state
    tells whether a code block, code span, quote or bracket is open, the line is a list item, and no blank has come yet.
    """
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size, last = len(codes), len(_KIND) - 1
    stop, blank = codes == 0, codes == 10
    stops = np.flatnonzero(stop)
    starts = np.r_[0, stops[:-1] + 1]
    heads = np.union1d(starts, np.flatnonzero(blank[:-1]) + 1)  # of lines
    blanks = np.flatnonzero(blank | (codes == 32))
    text, line = np.diff(starts, append=size), np.diff(heads, append=size)
    place = np.arange(size, dtype=np.int32)

    def is_odd(flags: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each bit of ``flags``, whether it is set an odd number of times since the text or line began."""
        total = np.bitwise_xor.accumulate(flags)
        return total ^ np.repeat((total ^ flags)[begin], lengths)

    tick = codes == 96
    third = np.flatnonzero(tick[2:] & tick[1:-1] & tick[:-2]) + 2
    fence = np.zeros(size, np.uint8)
    fence[third[(third < 3) | ~tick[third - 3]]] = 1
    step = (codes == 40).view(np.int8) - (codes == 41).view(np.int8)
    depth = np.cumsum(step, dtype=np.int32)
    inside = depth > np.repeat((depth - step)[heads], line)
    bare = place < np.repeat(np.r_[blanks, size][np.searchsorted(blanks, starts)].astype(np.int32), text)
    marked = np.isin(codes[heads], (45, 42, 43, 0x2022)) & (codes[np.minimum(heads + 1, size - 1)] == 32)
    listed = place > np.repeat(np.where(marked, heads + 1, size).astype(np.int32), line)
    state = is_odd(tick.view(np.uint8) << 2 | (codes == 34).view(np.uint8) << 3, heads, line)
    state |= listed.view(np.uint8) << 1 | inside.view(np.uint8) << 4 | bare.view(np.uint8) << 5
    if fence.any():
        state |= is_odd(fence, starts, text)
    kind = _KIND[codes] if codes.max() <= last else np.where(codes <= last, _KIND[np.minimum(codes, last)], codes)
    digit = kind == 48
    kind[2:][digit[2:] & digit[1:-1] & digit[:-2]] = 49  # longer numbers are no parts of versions
    lower = codes + ((kind == 65).view(np.uint8) << 5)
    at = stops[stops > 0] - 1
    at = at[~stop[at]] if last_only else np.flatnonzero(~stop)
    value = state.astype(np.uint64) + np.uint64(1)
    found = []
    for symbols, sizes, buckets in ((kind, END_CLASSES, CLASS_BUCKETS), (lower, (END_CHARS,), END_BUCKETS)):
        mixed, symbol = value.copy(), symbols.astype(np.uint64)
        for k in range(max(sizes)):
            if k:
                symbol[1:] = symbol[:-1]
                symbol[starts] = 0
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            mixed += symbol
            if k + 1 in sizes:
                hashed = mixed[at]
                hashed ^= hashed >> np.uint64(31)
                hashed *= np.uint64(0xBF58476D1CE4E5B9)
                found.append(((hashed >> np.uint64(32)) & np.uint64(buckets - 1)).view(np.int64))
    return found, stop[at + 1], (state & 0b100110)[at] != 0


class Ends:
    """How likely a text ends after its last characters: end-of-text n-gram likelihood with back-off to character classes."""

    def __init__(self, level: np.ndarray, bucket: np.ndarray, ends: np.ndarray, seen: np.ndarray) -> None:
        self.levels = []
        for k in range(len(END_CLASSES) + 1):
            own = np.flatnonzero(level == k)
            own = own[np.argsort(bucket[own])]
            self.levels.append(tuple(np.minimum(x[own], np.iinfo(np.int32).max).astype(np.int32) for x in (bucket, ends, seen)))

    def likelihood(self, texts: list[str]) -> np.ndarray:
        """For each text, none of them empty, how likely other texts end there: its own end is not counted.

        Longer contexts may speak for an end only where names stand. In prose and code they only speak against it, so
        that what is often cut off after the same word is not taken for complete. A name or lone word that is unknown
        may end.
        """
        likely = np.full(len(texts), 0.5)
        contexts, _, named = _end_contexts(texts, True) if texts else ([], None, None)
        for wanted, (bucket, ends, seen) in zip(contexts, self.levels):
            at = np.minimum(np.searchsorted(bucket, wanted), max(len(bucket) - 1, 0))
            held = bucket[at] == wanted if len(bucket) else np.zeros(len(wanted), bool)
            e, n = (np.where(held, x[at], 0) if len(bucket) else np.zeros(len(wanted)) for x in (ends, seen))
            longer = (np.maximum(e - 1, 0) + BACK_OFF * likely) / (np.maximum(n - 1, 0) + BACK_OFF)
            likely = longer if wanted is contexts[0] else np.where(named, longer, np.minimum(likely, longer))
        if len(contexts):
            likely = np.where(named & (n < NAME_SEEN), 1.0, likely)
        return likely


def fit_ends(asks: DataFrame, documents: DataFrame) -> Ends:
    """End-of-text counts of all answers, and of the paragraphs of all documents: these are complete, so they tell how texts
    go on. Of each level as many rows as it has buckets, at most, reach the driver."""
    sizes = (*(CLASS_BUCKETS for _ in END_CLASSES), END_BUCKETS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(np.zeros(n, np.int32), np.zeros(n, np.int32)) for n in sizes]
        for batch in batches:
            texts = [_ending(block) for text, whole in zip(batch["text"], batch["whole"]) for block in ([text] if whole else _blocks(text))]
            for start, stop in chunks(texts, 1 << 16):  # its arrays fit into a core's cache
                contexts, end, _ = _end_contexts(texts[start:stop], False)
                for bucket, (ends, seen) in zip(contexts, held):
                    np.add.at(ends, bucket[end], np.int32(1))
                    np.add.at(seen, bucket, np.int32(1))
        for level, (ends, seen) in enumerate(held):
            bucket = np.flatnonzero(seen)
            yield pd.DataFrame({"level": level, "bucket": bucket, "ends": ends[bucket], "seen": seen[bucket]})

    texts = asks.select(F.col("answer").alias("text"), F.lit(True).alias("whole")).where("text <> ''").unionByName(documents.select("text", F.lit(False).alias("whole")).where("text <> ''"))
    rows = texts.mapInPandas(count, "level int, bucket bigint, ends bigint, seen bigint").groupBy("level", "bucket").agg(F.sum("ends").alias("ends"), F.sum("seen").alias("seen"))
    known = rows.where((F.col("seen") >= LEAST_SEEN) | (F.col("level") < len(END_CLASSES))).toPandas()
    return Ends(*(known[n].to_numpy() for n in ("level", "bucket", "ends", "seen")))


_MORE = re.compile(r"""(?:\s*(?:…|\.{3,})|\s+[("'«“\[]+|\s+)*$""")
_NUMBER = re.compile(r"(?m)^\d+[.)](?=\s|$)")
#: All characters that ``_MORE`` may match: it is searched for only where nothing else follows.
_MORE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "….(\"'«“["


def _ending(answer: str) -> str:
    """The text up to its end, which is before dots that stand for more and marks that open something; numbered items as dashes."""
    text = visible(answer).replace("\0", " ").replace("\r\n", "\n")
    if "\n" in text or text[:1].isdecimal():
        text = _NUMBER.sub("-", text)
    return text[: _MORE.search(text, len(text.rstrip(_MORE_CHARS))).start()] or "."


def _blocks(text: str) -> list[str]:
    """The paragraphs of a document; code blocks stay whole."""
    found, held = [], ""
    for part in re.split(r"\n[ \t]*\n", text.replace("\r\n", "\n")):
        held = f"{held}\n\n{part}" if held else part
        if held.count("```") % 2 == 0:
            found.append(held)
            held = ""
    return [block for block in (*found, held) if block and not block.isspace()]


def are_truncated(answers: list[str], ends: Ends) -> np.ndarray:
    """Whether each answer, none of them blank, breaks off: it ends where texts hardly ever end."""
    return ends.likelihood([_ending(a) for a in answers]) < LIKELY_END


class NaiveBayes:
    """Languages' posteriors from character n-grams."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.weights = np.log((counts + 0.5) / (counts + 0.5).sum(axis=0)).astype(np.float32)

    def posteriors(self, texts: list[str]) -> np.ndarray:
        """One row a text, even where nothing is known."""
        found = np.full((len(texts), len(LANGUAGES)), 1 / len(LANGUAGES))
        for start, stop in chunks(texts):
            held = [text.split() for text in texts[start:stop]]
            code, words = pd.factorize(np.array([word for own in held for word in own], object))
            if not len(words):
                continue
            gram, owner = ngrams(words, SIZES)
            order = np.argsort(owner, kind="stable")
            of_word = np.add.reduceat(self.weights[(gram[order] % np.uint64(BUCKETS)).astype(np.int64)], np.flatnonzero(np.diff(owner[order], prepend=-1)), axis=0, dtype=np.float64)
            sizes = np.array([len(own) for own in held])
            own = np.flatnonzero(sizes)
            score = np.add.reduceat(of_word[code], (np.cumsum(sizes) - sizes)[own], axis=0)
            score = np.exp(score - score.max(axis=1, keepdims=True))
            found[start + own] = score / score.sum(axis=1, keepdims=True)
        return found


def _task_counts(found: Iterator[tuple[str, Counter[str]]]) -> Iterator[pd.DataFrame]:
    """Counts by bucket of the n-grams of a language's words, over a whole task: at most BUCKETS rows a language.

    No n-gram spans two words, so those of each distinct word are taken once and count as often as the word does.
    """
    held: dict[str, np.ndarray] = {}
    for language, words in found:
        gram, owner = ngrams(list(words), SIZES)
        times = np.fromiter(words.values(), np.float64, len(words))[owner]
        counts = held.setdefault(language, np.zeros(BUCKETS, np.int64))
        counts += np.bincount((gram % np.uint64(BUCKETS)).astype(np.int64), times, BUCKETS).astype(np.int64)
    for language, counts in held.items():
        gram = np.flatnonzero(counts)
        yield pd.DataFrame({"language": language, "gram": gram, "n": counts[gram]})


def _collected(texts: DataFrame, count: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> np.ndarray:
    """Counts by bucket and language; at most BUCKETS rows a language."""
    rows = texts.mapInPandas(count, "language string, gram bigint, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros((BUCKETS, len(LANGUAGES)))
    found[rows["gram"].to_numpy(), [LANGUAGES.index(x) for x in rows["language"]]] = rows["n"]
    return found


def fit_answers(documents: DataFrame) -> NaiveBayes:
    """The model of answers, from all documents with a label."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Counter[str]]]:
        for batch in batches:
            for language, group in batch.groupby("language"):
                for start, stop in chunks(whole := list(group["text"])):
                    yield language, prose_words(map(without_code, whole[start:stop]))

    return NaiveBayes(_collected(labelled(documents).select("language", "text"), lambda batches: _task_counts(words(batches))))


def fit_questions(asks: DataFrame, answers: NaiveBayes) -> NaiveBayes:
    """The model of questions: that of answers, and the questions of all asks, each counted for the language of its own
    answer where that is clear. Questions use words that documents lack, and few are answered in another language."""
    shared = asks.sparkSession.sparkContext.broadcast(answers)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Counter[str]]]:
        for batch in batches:
            for start, stop in chunks(list(batch["answer"])):
                questions, answers = (list(batch[c].iloc[start:stop]) for c in ("question", "answer"))
                said = [_said(a, q) for q, a in zip(questions, answers)]
                likely = shared.value.posteriors(said)
                best = likely.argmax(axis=1)
                clear = (likely.max(axis=1) > 0.999) & np.array([_letters(x) >= 40 for x in said], bool)
                for k in np.unique(best[clear]):
                    yield LANGUAGES[k], Counter(word for j in np.flatnonzero(clear & (best == k)) for word in _asked(questions[j])[0].split())

    known = asks.where(F.col("answer").isNotNull() & F.col("question").isNotNull()).select("question", "answer")
    return NaiveBayes(answers.counts + _collected(known, lambda batches: _task_counts(words(batches))))


def _asked(question: str) -> tuple[str, set[str]]:
    """The question's prose without requests for a language, and the languages asked for."""
    wanted: set[str] = set()
    kept = []
    for piece in sentences(without_code(question)):
        named = {_REQUESTED[w] for w in _words(piece) if w in _REQUESTED}
        wanted |= named
        if not named:
            kept.append(prose(piece))
    return " ".join(kept), wanted


def _said(answer: str, question: str) -> str:
    """The answer's prose without quoted lines, the question itself and list items."""
    lines = [line for line in without_code(answer.replace(question.strip(), " ")).split("\n") if not line.lstrip().startswith(">") and not _LIST.match(line)]
    return prose("\n".join(lines))


def _letters(text: str) -> int:
    return len(text) - text.count(" ")


def find_defects(questions: list[str | None], answers: list[str | None], ends: Ends, asking: NaiveBayes, answering: NaiveBayes) -> list[str | None]:
    """The defect of each pair, or None. A null question is an empty one."""
    found: list[str | None] = []
    open_: list[int] = []
    for k, (question, answer) in enumerate(zip(questions, answers)):
        if is_empty(answer):
            found.append("empty")
        elif is_copy(question or "", answer):
            found.append("copy")
        elif is_refusal(question or "", answer):
            found.append("refusal")
        else:
            found.append(None)
            open_.append(k)
    broken = are_truncated([answers[k] for k in open_], ends)
    for k in np.array(open_, int)[broken]:
        found[k] = "truncated"
    open_ = [k for k in open_ if found[k] is None]
    asked = [_asked(questions[k] or "") for k in open_]
    said = [_said(answers[k], questions[k] or "") for k in open_]
    one, two = asking.posteriors([a for a, _ in asked]), answering.posteriors(said)
    for j, k in enumerate(open_):
        q, a = int(one[j].argmax()), int(two[j].argmax())
        clear = one[j, q] >= SURE and two[j, a] >= SURE and _letters(asked[j][0]) >= LEAST_LETTERS and _letters(said[j]) >= LEAST_LETTERS
        if clear and q != a and LANGUAGES[a] not in asked[j][1]:
            found[k] = "language"
    return found


def answered(asks: DataFrame, turns: DataFrame) -> DataFrame:
    """Asks without a turn or with a completed one, each once. Of a turn the latest ``updated_at`` holds."""
    latest = turns.groupBy("id").agg(F.max(F.struct(instant(F.col("updated_at")).alias("at"), "status")).alias("last"))
    unfinished = latest.where(~F.col("last.status").eqNullSafe("completed")).select(F.col("id").alias("turn_id"))
    rows = asks.select("ask_id", "turn_id", "question", "answer")
    free, bound = rows.where(F.col("turn_id").isNull()), rows.where(F.col("turn_id").isNotNull())
    return free.unionByName(bound.join(unfinished, "turn_id", "left_anti").select(*rows.columns)).drop("turn_id")


def defective_pairs(asks: DataFrame, turns: DataFrame, documents: DataFrame) -> DataFrame:
    """``(ask_id, defect)``: empty, copy, refusal, truncated or language, the first that holds, for each defective pair.

    Truncation is judged by the likelihood that a text ends after its last characters, the language by the posteriors of
    question and answer. Repeated rows count once; pairs of failed or running turns
    are left out.
    """
    context = asks.sparkSession.sparkContext
    answering = fit_answers(documents)
    shared = context.broadcast((fit_ends(asks, documents), fit_questions(asks, answering), answering))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, stop in chunks([a or "" for a in batch["answer"]]):
                part = batch.iloc[start:stop]
                defects = find_defects(list(part["question"]), list(part["answer"]), *shared.value)
                rows = pd.DataFrame({"ask_id": part["ask_id"].to_numpy(), "defect": defects})
                yield rows[rows["defect"].notna()]

    found = answered(asks, turns).mapInPandas(run, "ask_id bigint, defect string")
    return found.groupBy("ask_id").agg(F.min("defect").alias("defect"))
