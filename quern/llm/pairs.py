"""Defective pairs of prompt and response.

Every pair gets at most one of ``empty``, ``refusal``, ``copied_question``, ``other_language`` and ``truncated``, tried in
this order.  Null, empty and blank responses are ``empty``; pairs with a null prompt can only be empty, a refusal or
truncated.  Languages are told by script, by function words, and by dictionaries and trigrams of letters that are learned
from all pairs; an answer in a language that nothing is known of is told by not being the question's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import truncation
from .languages import SPELLED, UNSEEN, Dictionaries, Letters, against, foreign_letters, language, main_script
from .learned import TRIGRAM, WORD, learn
from .words import fold, words

_MARKUP = regex.compile(r"<[^<>]*>|&\w+;|&#\d+;|[\p{P}\p{S}\p{Z}\p{C}\s]+")
#: What stands for no answer, folded, without punctuation.
PLACEHOLDERS = frozenset(
    ["", "na", "n a", "none", "null", "nil", "nan", "todo", "tbd", "tba", "vide", "empty", "sans reponse", "pas de reponse", "aucune reponse", "no answer", "no response", "answer", "reponse", "response", "a completer", "a venir", "undefined", "placeholder", "antwort", "respuesta", "keine antwort", "sin respuesta", "blank", "missing", "non renseigne", "ras", "xxx", "lorem ipsum", "text", "texte"]
)

PLACEHOLDER_WORDS = max(len(p.split()) for p in PLACEHOLDERS)

#: Wording by which an assistant declines, folded, by language; the first person keeps rules about refusals
#: out.  Each is a pattern over words.
REFUSAL_WORDS = {
    "fr": r"""je ne (?:saurais|puis|peux (?:pas|rien|ni|malheureusement pas)|pourrai pas|pourrais pas|suis pas (?:en mesure|autorise|habilite|capable|competent|certain|sur)|suis qu un|dispose (?:pas|d aucun)|sais pas|souhaite pas|trouve (?:pas|rien|aucun)|vois (?:pas|rien)|connais pas|possede pas|detiens pas)
        je (?:prefere|prefererais) ne pas
        je (?:m abstiens|dois m abstenir|refuse de|decline|renonce a|passe mon tour|laisse a d autres|dois (?:decliner|refuser|renoncer))
        je n ai (?:pas|trouve aucun|trouve rien|aucun|ni)\w*
        il (?:ne m (?:appartient|est)|n est pas de mon ressort|m est (?:impossible|interdit))
        on ne m autorise pas|ce n est pas a moi de|je ne me prononce pas|sans avis de ma part
        impossible (?:de (?:me|m|vous|conclure|repondre|donner|renseigner|trancher|se)|pour moi)
        (?:sort|sortent|depasse|depassent|excede|releve pas|au dela|hors|en dehors)(?: du cadre)?(?: de)? (?:le cadre de )?mes (?:competences|capacites|attributions|connaissances|possibilites)
        (?:le cadre|la limite|les limites) de mes (?:competences|capacites|attributions|connaissances|possibilites)
        mes (?:consignes|instructions|regles)|m interdi(?:t|sent)
        toute reponse serait|rien dans .{1,60}? ne (?:me )?permet|ne (?:me )?permet(?:tent)? pas de (?:conclure|repondre)
        informations? (?:non |in)disponibles?|informations? insuffisantes?
        ne dit rien (?:au chapitre|sur|de|a ce sujet)|aucune mention|faute d (?:elements|informations?)|pas assez d (?:elements|informations?)""",
    "en": r"""i (?:can not|cannot|can t|could not|couldn t|am unable|m unable|am not (?:able|sure|certain|in a position|allowed|qualified)|m not (?:able|sure|certain|in a position|allowed|qualified)|would rather not|d rather not|prefer not|must (?:decline|pass|refuse)|have to (?:decline|pass)|decline|have no (?:basis|information|way|answer|idea)|do not (?:have|know)|don t (?:have|know)|found no|won t|will not)
        i (?:must|have to|will|ll|d rather) pass(?: on)?
        it is not my place|it s not my place|not my place to|not for me to
        (?:beyond|outside|exceeds?|above) (?:the (?:scope|limits?|bounds) of )?my (?:remit|competence|scope|knowledge|abilities|capabilities|training)
        my (?:instructions|guidelines|rules) (?:forbid|prevent|do not)
        (?:there is )?not enough (?:in|information|context)|nothing in .{1,60}? (?:lets|allows) me|says nothing about|no mention of|information (?:is )?(?:not available|unavailable)|any answer would be""",
    "de": r"""ich (?:kann|darf|mochte|will|werde) (?:\w+ ){0,4}(?:nicht|keine|nichts|dazu nichts)
        ich (?:weiss (?:es |das )?nicht|bin nicht (?:in der lage|befugt|berechtigt|sicher)|habe (?:dazu |leider )?(?:keine|kein|nichts)|muss (?:\w+ ){0,3}passen|enthalte mich)
        es ist mir nicht (?:moglich|erlaubt|gestattet)|ubersteigt (?:meine|mein)|ausserhalb meiner|(?:reicht|reichen) (?:\w+ ){0,3}nicht aus|keine angaben|dazu liegen mir""",
    "es": r"""(?:yo )?no (?:puedo|podria|se|dispongo|tengo|estoy (?:en condiciones|autorizado|seguro)|me corresponde|me es posible|encuentro|he encontrado)
        me es imposible|prefiero no|debo (?:abstenerme|declinar)|me abstengo|(?:fuera|mas alla) de mis|supera mis|excede mis|informacion (?:no disponible|insuficiente)|no hay (?:suficiente|informacion)""",
    "it": r"""non (?:posso|saprei|so|sono in grado|dispongo|ho (?:trovato|informazioni|elementi)|mi e possibile|mi compete)
        preferisco non|devo astenermi|mi astengo|oltre le mie|va oltre le mie|al di fuori delle mie""",
    "pt": r"""nao (?:posso|sei|consigo|disponho|tenho|estou em condicoes|me compete|me e possivel|encontrei)
        prefiro nao|devo abster|abstenho me|fora (?:do meu|da minha|das minhas)|alem (?:do meu|da minha|das minhas)""",
    "nl": r"""ik (?:kan|mag|wil|weet) (?:\w+ ){0,4}(?:niet|geen|niets)
        ik (?:ben niet (?:in staat|bevoegd|zeker)|heb (?:\w+ ){0,2}(?:geen|niets)|moet (?:\w+ ){0,3}passen)|buiten mijn|gaat mijn (?:\w+ )?te boven""",
}
REFUSALS = re.compile(r"\b(?:" + "|".join("|".join(x.strip() for x in v.split("\n")) for v in REFUSAL_WORDS.values()) + r")\b")
#: How an answer opens that will not be given.
APOLOGIES = re.compile(r"^(?:(?:bonjour|hello|hi|hallo|hola|ciao|ola|merci|thank you|thanks|danke|gracias)(?: \w+){0,4} )?(?:je (?:suis|regrette)(?: vraiment| sincerement)? (?:desolee?|navree?)|desolee?|navree?|toutes mes excuses|veuillez m excuser|(?:i m|i am)(?: so| very| really)? sorry|sorry|my apologies|i apologi[sz]e|es tut mir leid|tut mir leid|entschuldigung|lo siento|lo lamento|disculpe|mi dispiace|mi spiace|desculpe|lamento|sinto muito|het spijt me|przykro mi)\b")
_SENTENCES = regex.compile(r"(?<=[.!?;])\s+|\n+")
QUOTES = "«“\""
_QUOTED = regex.compile(r"«[^«»]*»|“[^“”]*”|\"[^\"]*\"")


def is_empty(response: str | None) -> bool:
    """Nothing but blanks, punctuation, markup or a placeholder."""
    if response and "<" not in response and "&" not in response:
        return len(ws := words(response)) <= PLACEHOLDER_WORDS and " ".join(ws) in PLACEHOLDERS
    return response is None or fold(_MARKUP.sub(" ", response)).strip() in PLACEHOLDERS


#: An apology is a refusal if the response has at most so many words; what else it says, beside a sentence that declines.
APOLOGY_WORDS, BESIDE_WORDS = 30, 14


def is_refusal(said: list[list[str]]) -> bool:
    """The sentences decline: in the first with more than an opening, or in a later one if the others say little, or they
    are short and open with an apology."""
    declines = [REFUSALS.search(" ".join(ws)) is not None for ws in said]
    if any(declines):
        first = next((k for k, ws in enumerate(said) if len(ws) > 3), len(said))
        if any(declines[: first + 1]) or sum(len(ws) for ws, no in zip(said, declines) if not no) <= BESIDE_WORDS:
            return True
    return sum(map(len, said)) <= APOLOGY_WORDS and APOLOGIES.match(" ".join(w for ws in said[:2] for w in ws)) is not None


#: Level of the compressor: the texts are short, so a higher one finds nothing more.
LEVEL = 6


@lru_cache(maxsize=1)
def _plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)


@lru_cache(maxsize=256)
def _compressor(question: str) -> zstandard.ZstdCompressor:
    """Its dictionary is the question; the same one often comes again."""
    known = zstandard.ZstdCompressionDict(question.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, dict_data=known)


def copied_share(question: str, response: str) -> float:
    """How much shorter the response gets when it is compressed with the question as its dictionary: 1 for a copy."""
    # zstd finds matches of a few bytes; the frame and the literals' header are left out by comparing with nothing
    data = response.encode()
    alone = len(_plain().compress(data))
    given = _compressor(question).compress(data)
    least = 12
    return (alone - len(given)) / max(alone - least, 1)


#: Share from which a response may be a copy, and the share of its words that may stand outside the question.
COPIED, FOREIGN_WORDS = 0.3, 0.3


def is_copy(q: list[str], r: list[str]) -> bool:
    """Whether the words of a response give back those of the question."""
    if len(q) < 4 or len(r) < 0.6 * len(q):
        return False
    # no copy without half of the question's words: the compressor needn't look
    asked = set(q)
    if 2 * len(asked.intersection(r)) < len(asked):
        return False
    if copied_share(" ".join(q) + " ", " ".join(r) + " ") < COPIED:
        return False
    # what the compressor took from the question, checked word by word
    pairs = set(zip(q, q[1:]))
    shared = [x in pairs for x in zip(r, r[1:])]
    covered = sum(a or b for a, b in zip([False, *shared], [*shared, False]))
    back = set(zip(r, r[1:]))
    given = sum(p in back for p in zip(q, q[1:])) / (len(q) - 1)
    after = next((k for k, (a, b) in enumerate(zip([*shared[::-1], False], [False, *shared[::-1]])) if a or b), len(r))
    return after <= 1 and len(r) - covered <= max(6, FOREIGN_WORDS * len(q)) and given >= 0.6


#: By how much (in natural logarithms) another language must be likelier for a whole response, and its own for one of
#: its sentences to be in the question's.
MARGIN, OWN_MARGIN = 4.0, 2.0
#: Letters of a response that tell its script, and the share of them that one script must have; words that tell a
#: language by its letters, and the share of them that must hold one that the question's language doesn't write.
SCRIPT_LETTERS, SCRIPT_SHARE, LETTER_WORDS, LETTER_SHARE = 4, 0.8, 5, 0.15


def is_other_language(question: str, bare: str, asked_words: list[str], said: list[list[str]], learned: Dictionaries | None = None, letters: Letters | None = None) -> bool:
    """The response, without what it quotes, is wholly in another language than the question, whether that is a known one
    or not."""
    asked, answered = main_script(question), main_script(bare)
    if asked[0] and answered[0] and asked[0] != answered[0]:
        return sum(map(str.isalpha, bare)) >= SCRIPT_LETTERS and min(asked[1], answered[1]) >= SCRIPT_SHARE
    own = language(asked_words, 1, ties=True)
    ws = [w for sentence in said for w in sentence]
    if own is None or len(ws) < 2:
        return False
    if len(ws) >= LETTER_WORDS and sum(map(SPELLED[own].__contains__, ws)) <= 0.1 * len(ws):
        # a language of which nothing is known but that it isn't the question's
        unseen = letters.unseen(ws, own) if letters else None
        if unseen is not None and unseen >= UNSEEN and unseen >= 2 * letters.unseen(asked_words, own) + 0.05:
            return True
        if foreign_letters(bare, own) >= max(2, LETTER_SHARE * len(ws)):
            return True
    for _, there, here in against(ws, own):
        if there >= 2 and there >= 2 * here + 1 and there >= 0.12 * len(ws):
            return True
    if learned is None or own not in learned.languages:
        return False
    scores, known = learned.scores(ws)
    if known < 3 or max(scores.values()) - scores[own] < MARGIN:
        return False
    for sentence in said:
        scores, known = learned.scores(sentence)
        if known >= 3 and scores[own] - max(v for x, v in scores.items() if x != own) >= OWN_MARGIN:
            return False
    return True


def defect(question: str | None, response: str | None, learned: Dictionaries | None = None, letters: Letters | None = None) -> str | None:
    if is_empty(response):
        return "empty"
    bare = _QUOTED.sub(" ", response) if any(q in response for q in QUOTES) else response
    said = [ws for x in _SENTENCES.split(bare) if (ws := words(x))]
    if is_refusal(said):
        return "refusal"
    if question and not is_empty(question):
        q = words(question)
        if is_copy(q, words(response)):
            return "copied_question"
        if is_other_language(question, bare, q, said, learned, letters):
            return "other_language"
    return None


def defects(pairs: DataFrame, values: DataFrame, corpus: DataFrame | None = None, checkpoint=lambda df: df, kinds=None) -> DataFrame:
    """``id`` and ``defect`` of the defective rows of ``pairs`` (id, question, response, with distinct ids).

    ``values``, ``corpus``, ``checkpoint`` and ``kinds`` are those of ``truncation.cut_values``, with the same ids as keys."""
    found, letters = learn(pairs.select("question", "response"), WORD, TRIGRAM)
    learned = pairs.sparkSession.sparkContext.broadcast((Dictionaries(found), Letters(letters)))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [defect(q, r, *learned.value) for q, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], names=["id", "own"])

    own = pairs.select("id", "question", "response").mapInArrow(label, "id string, own string").where("own is not null")
    cut = truncation.cut_values(values, corpus, checkpoint, kinds).select(F.col("key").alias("id"), F.lit("truncated").alias("cut"))
    return own.join(cut, "id", "full").select("id", F.coalesce("own", "cut").alias("defect"))
