"""Problem 2: defective prompt and response pairs, by ordered rules.

Every pair is judged by its answer; a rule that triggers names a defect type:

empty           null, or no letter and no digit
copy            nothing but the question or its beginning, in any case, spacing, punctuation
                or repetition, perhaps with one word of the question or a function word behind it
refusal         a sentence that opens with a refusal: the first person with a negated ability
                or will and a verb of answering, or a fixed phrase, in eight languages and
                Japanese, Chinese, Korean and Arabic
other_language  another script than the question's, or function words of another
                language, and the question asks for no such language or translation
truncated       an unclosed bracket, quotation or code fence, an open list marker or hyphen, or an
                ending that the corpus never closes a sentence with (see `ending_counts`)

`pair_defects` emits every triggered type, `first_defects` the first in the order above.

Null or empty `texts`, null turns and a null row_id take no part; a missing
question alone is no defect. A row delivered twice counts once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinwell.sources.session import cut
from thinwell.sources.tables import spread

ORDER = ("empty", "copy", "refusal", "other_language", "truncated")

# Function words by language.
FUNCTION_WORDS = {
    "en": "the a no of and to in is that for it on with as was which by from at this what who where does how under next about an are its has not read could please you me were been have had will would can should there their they his her we our your my but or if than then also any all some such into between after before because while when why did do describe best following say give",
    "de": "der die das und von zu den mit für auf ist im nicht ein eine dem des wird bitte welche welcher wer wo sie aus am laut über ohne unter wann warum auch hier zum zur neben können finde ich beschreiben mir dass oder aber wenn als wie sind war waren hat haben werden kann einem einer eines einen bis zwischen seit durch gegen bei nach vor während dieser diese dieses ihre er es wir sagt",
    "fr": "le la les de des du et un une dans pour sur est au aux que qui où quelle quel par avec ce selon sans plusieurs pourquoi quand pas vous en sous quels quelles comment dit concernant plaît décrivez pourriez puis trouver été être ont sont était même mais ou donc car si comme tandis alors entre leur leurs ses son sa cette ces cet nous ils elles il elle on je lire ligne a l d n s",
    "es": "el la los las de del y en un una que para por con se su al dónde qué cuál quién según sin más varias cuándo como lo es debajo cómo dice describa favor podría leerme puedo encontrar mientras pero o si está son fue ser hay este esta estos entre hasta desde sobre también muy ya sus nos fila a no",
    "it": "il lo la gli le di del della dello dei delle e in un una che per con da al alla dove quale chi secondo senza più nel nella cosa si anche sotto quando come perché posso trovare descriva favore potrebbe leggere mi riga mentre ma o se sono è era essere ha hanno questo questa questi tra fino dal dalla sul sulla molto già suo sua loro uno l i a no",
    "pt": "o a os as de do da dos das e em um uma que para por com no na ao onde qual quem segundo sem mais não se sobre foi pelo pela quando como porque posso encontrar descreva favor poderia ler linha enquanto mas ou são é era ser há este esta estes entre até desde também muito já seu sua seus nos nas diz",
    "nl": "de het een van en in is op voor met aan bij te dat die wie waar welke volgens onder zonder naar over deze uit wat ook niet tot om wanneer hoe waarom kan kunt u vinden beschrijf alstublieft voorlezen mij regel terwijl maar of als zijn was waren worden wordt heeft hebben dit tussen sinds door na tijdens haar hij zij wij hun zegt",
    "ru": "и в на не что с по для из от к о за под это кто где какой какая без согласно во при почему когда",
}
# Names of the eight languages as a request may give them, by the language named.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles inglese inglês engels английск",
    "de": "german deutsch allemand alemán aleman tedesco alemão duits немецк",
    "fr": "french französisch français francais francés frances francese francês frans французск",
    "es": "spanish spanisch espagnol español espanol castellano spagnolo espanhol spaans испанск",
    "it": "italian italienisch italien italiano italiaans итальянск",
    "pt": "portuguese portugiesisch portugais portugués portugues portoghese português portugees португальск",
    "nl": "dutch niederländisch néerlandais neerlandés holandés olandese holandês nederlands голландск нидерландск",
    "ru": "russian russisch russe ruso russo русск",
}
# What may come before a refusal, and refusals, by language.
APOLOGIES = r"(?:i'm (?:very |so |really )?sorry|i am sorry|sorry|unfortunately|regrettably|(?:my )?apologies|i apologi[sz]e|thanks? (?:you )?for asking|désolée?|je suis désolée?|malheureusement|excusez-moi|es tut mir leid|tut mir leid|leider|bedaure|entschuldigung|lo siento|lamentablemente|desafortunadamente|por desgracia|disculpe|mi dispiace|purtroppo|spiacente|scusi|desculpe|infelizmente|lamento|sinto muito|helaas|het spijt me|excuses|no|nein|non|nee|нет|извините|простите|к сожалению|увы)"
REFUSALS = (
    r"(?:i|we) (?:cannot|can't|can not|could not|couldn't|will not|won't|am unable to|am not able to|won't be able to|will not be able to|do not wish to|don't wish to|am not allowed to|am not permitted to|must decline to|have to decline to|must refuse to|refuse to) (?:be able to )?(?:answer|help|assist|share|discuss|comment|provide|describe|respond|reply|comply|fulfil|go into|talk about|say|give|read documents|view|see (?:the )?(?:image|picture|page)|process|do (?:that|this)|support)",
    r"(?:i|we) (?:must|have to) (?:refrain from|abstain from) ",
    r"(?:i'd|i would|we'd|we would) (?:rather|prefer) not(?: to)? (?:go into|answer|comment|say|discuss|share|respond|describe)",
    r"i prefer not to (?:answer|comment|say|discuss|share|respond|describe|go into)",
    r"(?:that|this|it) is something (?:i|we) (?:have to|must) decline",
    r"(?:that|this|it) (?:falls|lies|is) (?:outside|beyond) what (?:i|we) (?:may|can|am|are)",
    r"it (?:isn't|is not) possible for me to ",
    r"(?:my|our) (?:guidelines|rules|policies|policy|instructions) (?:keep|prevent|stop|bar|forbid|prohibit|do not allow|don't allow)",
    r"as an? [\w ]{0,30}?(?:ai|system|assistant|model|chatbot|bot)\b[\w ,]{0,25}?\b(?:i|we) (?:have no way|cannot|can't|am unable|am not able|do not|don't)",
    r"answering (?:that|this) would mean ",
    r"i must decline(?: this| that| your| to|[.!]|$)",
    r"je ne (?:peux|puis|pourrai) (?:pas |malheureusement pas )?(?:répondre|aider|vous aider|commenter|partager|décrire|donner|fournir|en parler|en discuter|traiter)",
    r"je ne suis (?:malheureusement )?pas (?:en mesure|autorisée?|capable|habilitée?)",
    r"je préfère ne pas ", r"je dois (?:décliner|refuser|m'abstenir)", r"il (?:m'est impossible|ne m'est pas possible|ne m'est pas permis)",
    r"ich (?:kann|darf|möchte|werde|könnte) (?:[\wäöüß]+ ){0,5}?nicht (?:beantworten|helfen|äußern|kommentieren|beschreiben|besprechen|weitergeben|sagen|antworten|eingehen|weiterhelfen|teilen)",
    r"(?:das|dies|hierzu|dazu|dabei|damit|darüber|hierbei|da) (?:[\wäöüß]+ ){0,4}?(?:kann|darf|möchte|werde) ich (?:[\wäöüß]+ ){0,3}?nicht",
    r"(?:das|dies|eine|die) (?:[\wäöüß]+ ){0,5}?ist mir (?:leider )?nicht (?:möglich|gestattet|erlaubt)", r"es ist mir (?:leider )?nicht (?:möglich|gestattet|erlaubt)", r"ich (?:muss|möchte) (?:das |dies |die bitte |diese bitte )?(?:ablehnen|davon absehen)",
    r"no (?:puedo|podré|podría) (?:responder|contestar|ayudar|comentar|compartir|describir|dar|hablar|atender)", r"prefiero no ", r"no (?:tengo permitido|se me permite|estoy autorizad[oa]|estoy en condiciones)", r"no me (?:es posible|está permitido|permiten)", r"debo (?:declinar|rechazar|abstenerme)",
    r"non (?:posso|potrò|potrei) (?:rispondere|aiutare|aiutarla|aiutarti|commentare|condividere|descrivere|fornire|parlarne)", r"non sono (?:in grado|autorizzat[oa]|abilitat[oa])", r"preferisco non ", r"devo (?:declinare|rifiutare|astenermi)", r"non mi è (?:possibile|permesso|consentito)",
    r"não (?:posso|poderei|consigo) (?:responder|ajudar|comentar|partilhar|compartilhar|descrever|fornecer|falar)", r"prefiro não ", r"não (?:tenho permissão|estou autorizad[oa]|tenho autorização|me é possível|me é permitido)", r"(?:devo|tenho de|tenho que) (?:recusar|declinar)",
    r"ik (?:kan|mag|wil|zal) (?:[\w]+ ){0,4}?niet (?:beantwoorden|helpen|bespreken|delen|beschrijven|bij helpen|op ingaan|zeggen|over praten)", r"(?:daar|hier|dat|dit|hierover|daarover|daarmee|hiermee) (?:kan|mag|wil) ik (?:[\w]+ ){0,3}?niet", r"(?:hierover|daarover|daar|hier) doe ik liever geen", r"ik (?:doe|geef) (?:hier|daar)?(?:over)? ?liever geen", r"ik (?:moet|wil) (?:dit|dat|uw verzoek|het verzoek)? ?(?:weigeren|afwijzen|afslaan)", r"het is (?:mij|me) niet (?:mogelijk|toegestaan)",
    r"я не (?:могу|смогу|имею права|буду|вправе|готов[а]?) ", r"не могу (?:ответить|помочь|обсуждать|комментировать|описать|поделиться)", r"(?:помочь|ответить) (?:с этим|на это|вам|здесь)? ?(?:не получится|не могу|не смогу|я не могу)", r"мне (?:не разрешено|нельзя|запрещено|не позволено)", r"(?:я )?предпочту (?:не |воздержаться)", r"(?:я )?предпочитаю не ", r"(?:я )?вынужден[а]? (?:отказать|отклонить|воздержаться)",
)
# Verbs of answering, by language.
SPEAKING = {
    "en": "answer|help|assist|share|discuss|comment|provide|describe|respond|reply|comply|fulfil|go into|talk|say|tell|give|speak|elaborate|disclose|reveal",
    "fr": "répondre|aider|commenter|partager|décrire|donner|fournir|parler|discuter|traiter|dire|révéler",
    "de": "beantworten|antworten|helfen|weiterhelfen|äußern|kommentieren|beschreiben|besprechen|weitergeben|sagen|eingehen|teilen|mitteilen|nennen|verraten",
    "es": "responder|contestar|ayudar|comentar|compartir|describir|dar|hablar|atender|decir|proporcionar",
    "it": "rispondere|aiutare|commentare|condividere|descrivere|fornire|parlare|dire|dare",
    "pt": "responder|ajudar|comentar|partilhar|compartilhar|descrever|fornecer|falar|dizer|dar",
    "nl": "beantwoorden|antwoorden|helpen|bespreken|delen|beschrijven|zeggen|praten|geven|ingaan",
    "ru": "ответить|отвечать|помочь|обсуждать|комментировать|описать|поделиться|сказать|предоставить|говорить",
}
# The first person with a negated ability or will, by language; a verb of answering follows within a few words.
UNWILLING = {
    "en": r"(?:i|we)(?:(?: am|'m| are|'re) (?:just |simply |really )?(?:not (?:going|able|allowed|permitted|willing|prepared|in a position|at liberty|supposed) to|unable to|unwilling to)|(?: do not|'d not| don't| would not| wouldn't) (?:want|wish|like|care|intend) to)",
    "fr": r"(?:je|nous) (?:ne|n')\s?(?:peux|puis|pourrai|pourrais|veux|souhaite|vais|saurais|dois|pouvons|souhaitons) ?(?:malheureusement)?(?: ?pas)?(?: (?:vous|te|y|en|la|le|lui|leur|l'|m'|d'))*",
    "de": r"(?:ich|wir) (?:kann|darf|möchte|werde|will|können|dürfen|möchten|werden|wollen) (?:[\wäöüß]+ ){0,6}?nicht(?: [\wäöüß]+){0,3}?",
    "es": r"no (?:puedo|podré|podría|quiero|deseo|voy a|debo|podemos)(?: te| le| lo| la| se)?",
    "it": r"non (?:posso|potrò|potrei|voglio|desidero|intendo|devo|possiamo)",
    "pt": r"não (?:posso|poderei|poderia|consigo|quero|desejo|vou|devo|podemos)(?: lhe| te| o| a)?",
    "nl": r"(?:ik|wij|we) (?:kan|mag|wil|zal|ga|kunnen|mogen|willen) (?:[\w]+ ){0,5}?niet(?: [\w]+){0,2}?",
    "ru": r"(?:я|мы) не (?:могу|смогу|буду|хочу|стану|намерен[аы]?|можем|будем)(?: вам| на это| это)?",
}
# Refusals of other languages, and in the passive.
OTHER_REFUSALS = (
    r"(?:your|this|that) (?:request|question) (?:is|must be|has to be|cannot be|can't be|will not be|won't be) (?:declined|refused|denied|rejected|answered)",
    r"(?:[^。\n]{0,20}?)(?:お答え|回答|お手伝い|対応|ご説明|お伝え)[^。\n]{0,8}?(?:できません|できかねます|致しかねます|いたしかねます|控え)",
    r"(?:[^。\n]{0,12}?)(?:无法|無法|不能|不便|拒绝|拒絕)[^。\n]{0,6}?(?:回答|提供|协助|協助|帮助|幫助|讨论|討論|评论|回应)",
    r"(?:[^.\n]{0,20}?)(?:답변|답|도움|도와|제공|설명)[^.\n]{0,10}?(?:할 수 없|드릴 수 없|줄 수 없|수 없습니다|어렵습니다)",
    r"(?:[^.\n]{0,16}?)لا (?:أستطيع|يمكنني|أقدر)[^.\n]{0,12}?(?:الإجابة|مساعدتك|المساعدة|الرد|الحديث)",
)
# Words by which a question asks for a translation, and names of scripts' languages in it.
TRANSLATING = re.compile(r"transl|übersetz|uebersetz|tradui|traduc|traduz|traduç|tradur|vertal|vertaal|перев[ео]")
SCRIPT_NAMES = {
    "GREEK": "greek griech grec grieg greco grego grieks греческ", "ARABIC": "arab persian farsi urdu арабск", "HEBREW": "hebr иврит", "CJK": "chinese chines chinois chino cinese japan japon giappon kanji китайск японск",
    "HANGUL": "korea coré corea корейск", "CYRILLIC": "russi russe ruso russo ukrain bulgar serb cyril русск", "THAI": "thai", "DEVANAGARI": "hindi sanskrit marathi nepali", "LATIN": "latin english englisch anglais inglés inglese inglês engels английск french german deutsch spanish",
}
QUESTION_LABELS = frozenset(("q", "a", "question", "answer", "frage", "antwort", "pregunta", "respuesta", "domanda", "risposta", "pergunta", "resposta", "vraag", "antwoord", "вопрос", "ответ", "réponse"))

REFUSAL = re.compile(rf"(?:^|[.!?…:。！？]\s*(?<=[\s。！？]))[\s>“”\"'«»*_#-]*(?:{APOLOGIES}[\s,:;.!–—-]+(?:but |however,? |however |mais |aber |doch |pero |ma |mas |maar |но )?)*(?:{'|'.join((*REFUSALS, *OTHER_REFUSALS, *(rf"{UNWILLING[k]}\s?(?:{SPEAKING[k]})" for k in UNWILLING)))})")
VOTES: dict[str, list[str]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        VOTES.setdefault(_word, []).append(_language)
NAMED = [(language, re.compile("|".join(names.split()))) for language, names in LANGUAGE_NAMES.items()]
WORDS = re.compile(r"\w+")
LETTERS = re.compile(r"[^\W\d_]+")
ALNUM = re.compile(r"[^\W_]+")
CYRILLIC = re.compile(r"[Ѐ-ӿ]")
BEYOND_LATIN = re.compile(r"[^\W\d_\u0000-\u024f]")

#: A token that holds a digit, without the punctuation that closes it.
NUMBER = re.compile(r"(?<!\S)[^\s\d]*\d\S*?(?=[.,;:!?)”\"»]*(?:\s|$))")
PUNCTUATION = frozenset(".!?,;:…")
CLOSED = re.compile(r"([^\W\d_]+)[)”\"»’]*([.!?,;:…])$")
BEFORE_NUMBER = re.compile(r"\b([^\W\d_]+)\s+0(?!\w)(?:[)”\"»’]*([.!?,;:…])(?=\s|$))?")
OPEN_END = re.compile(r"(?:(?:^|\n)\s*(?:\d+[.)]|[-*•–])|[^\W\d_]-|[,(\[{„«])\s*$")
CLOSING = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "“": "„"}
DELIMITERS = re.compile(r"```|(?<![:;=8])[(\[{]|[)\]}“”„«»]|(?<!\d)\"")
#: Blank-separated words, or letters of a script without blanks, from which an answer's language is judged.
SHORT_ANSWER, SHORT_LETTERS = 3, 6
#: Words and share of the question that a copied beginning of it has at least.
COPIED_WORDS, COPIED_SHARE = 4, 0.5
#: Words of an answer that counts as short, where a bare noun phrase is complete.
SHORT = 5
#: Occurrences from which an ending's statistics count, the share of full stops in answers under which it is no ending,
#: and for short answers, where a bare noun phrase is complete: the occurrences, and the share of any punctuation.
SUPPORT, SUPPORT_SHORT, CLOSES, CLOSES_SHORT = 20, 250, 0.008, 0.004
#: Answers with one ending from which its statistics are broadcast, at most one row for each so many answers.
HOT_ENDING = 100_000


def last_key(text: str) -> str | None:
    """What `text` ends with, as ending_counts has it; None after closing punctuation."""
    tail = text.rsplit(None, 2)
    if not tail:
        return None
    token = NUMBER.sub("0", tail[-1])
    if token == "0":
        before = LETTERS.findall(tail[-2]) if len(tail) > 1 else []
        return f"{before[-1].lower()} 0" if before and tail[-2].endswith(before[-1]) else " 0"
    letters = LETTERS.findall(token)
    return letters[-1] if letters and token.endswith(letters[-1]) else None


def closed_words(text: str) -> list[tuple[str, str]]:
    """The words of `text` that punctuation follows, with the sign that ends the token."""
    return [(m[1], m[2]) for token in text.split() if token[-1] in PUNCTUATION and (m := CLOSED.search(token))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen, stopped, paused, bare = Counter(), Counter(), Counter(), Counter()
        for users, answers in zip(batch.column("user").to_pylist(), batch.column("assistant").to_pylist()):
            for text in users or []:
                if text:
                    seen.update(LETTERS.findall(text))
                    paused.update(word for word, _ in closed_words(text))
            for text in answers or []:
                if not text:
                    continue
                flat = NUMBER.sub("0", text)
                seen.update(LETTERS.findall(flat))
                closed = closed_words(flat)
                if " 0" in flat:
                    before = [(f"{word.lower()} 0", sign) for word, sign in BEFORE_NUMBER.findall(flat)]
                    seen.update(word for word, _ in before)
                    closed += [x for x in before if x[1]]
                paused.update(word for word, _ in closed)
                stopped.update(word for word, sign in closed if sign in ".!")
                if key := last_key(text):
                    bare[key] += 1
        keys = list(seen.keys() | bare.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (seen, stopped, paused, bare))], ["ending", "seen", "stopped", "paused", "bare"])


def ending_counts(pairs: DataFrame) -> DataFrame:
    """Per word, and per word before a number ("word 0"), how often it occurs, closes a
    sentence of an answer with a full stop, stands before any punctuation, and ends an answer bare. Counted over all rows."""
    counted = pairs.mapInArrow(_count, "ending string, seen bigint, stopped bigint, paused bigint, bare bigint")
    return counted.groupBy("ending").agg(*(F.sum(c).alias(c) for c in ("seen", "stopped", "paused", "bare")))


def language_votes(text: str) -> dict[str, float]:
    """Function words of each language in `text`, a word of n languages counting 1/n for each; Cyrillic words count for ru.

    Words with a digit in them, as in codes and checksums, count for none.
    """
    votes = dict.fromkeys(FUNCTION_WORDS, 0.0)
    words = WORDS.findall(text.lower())
    for word in words:
        for language in VOTES.get(word, ()):
            votes[language] += 1 / len(VOTES[word])
    if CYRILLIC.search(text):
        votes["ru"] += sum(CYRILLIC.match(word) is not None for word in words)
    return votes


def language_of(votes: dict[str, float]) -> str | None:
    """The language with a vote of at least one and one and a half times that of any other, else None."""
    first, second = sorted(votes.values(), reverse=True)[:2]
    return max(votes, key=votes.__getitem__) if first >= 1 and first >= 1.5 * second else None


def scripts(text: str) -> Counter:
    """Letters of each script in `text`, kanji and kana under CJK."""
    beyond = Counter(BEYOND_LATIN.findall(text)) if not text.isascii() else Counter()
    found: Counter = Counter()
    for letter, n in beyond.items():
        name = unicodedata.name(letter, "").partition(" ")[0]
        found["CJK" if name in ("HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA") else name] += n
    found["LATIN"] += sum(map(len, LETTERS.findall(text))) - beyond.total()
    return found


def _other_script(question: str, answer: str, low: str) -> bool:
    if question.isascii() and answer.isascii():
        return False
    given, asked = scripts(answer), scripts(question)
    script, letters = given.most_common(1)[0]
    if len(answer.split()) < SHORT_ANSWER and (letters < SHORT_LETTERS or script not in ("CJK", "THAI")):
        return False
    if 2 * letters <= given.total() or asked.total() < SHORT_LETTERS or 4 * asked[script] > asked.total():
        return False
    return not TRANSLATING.search(low) and not any(name in low for name in SCRIPT_NAMES.get(script, script.lower()).split())


def _other_language(question: str, answer: str) -> bool:
    low = question.lower()
    if _other_script(question, answer, low):
        return True
    votes = language_votes(answer)
    given = language_of(votes)
    if given is None or len(answer.split()) < SHORT_ANSWER:
        return False
    asked = language_of(language_votes(question))
    if asked is None or given == asked or 2 * votes[asked] > votes[given]:
        return False
    return not any(language == given and names.search(low) for language, names in NAMED)


def _squeezed(text: str) -> list[str]:
    return ALNUM.findall(unicodedata.normalize("NFKC", text).casefold())


def _copied(question: str, answer: str) -> bool:
    words, asking = _squeezed(answer), _squeezed(question)
    if not asking:
        return False
    if words[0] in QUESTION_LABELS and asking[0] != words[0]:
        words = words[1:]

    def copies(given: str, n: int) -> bool:
        asked = "".join(asking)
        if not given or not (asked * (len(given) // len(asked) + 1)).startswith(given):
            return False
        # Whole repetitions, or as much of the question that it is no chance.
        return len(given) % len(asked) == 0 or n >= COPIED_WORDS and len(given) >= COPIED_SHARE * len(asked)

    if copies("".join(words), len(words)):
        return True
    return len(words) > max(COPIED_WORDS, len(asking)) and (words[-1] in asking or words[-1] in VOTES) and copies("".join(words[:-1]), len(words) - 1)


def unclosed(text: str) -> bool:
    """Whether a bracket, quotation or code fence is left open; a mark before the first word, as around a whole answer, aside."""
    first = ALNUM.search(text)
    start = first.start() if first else 0
    held: list[str] = []
    for found in DELIMITERS.finditer(text):
        mark = found[0]
        if mark in ('"', "```"):
            # The same sign opens and closes; inside a fence nothing else counts.
            if mark in held:
                del held[held.index(mark) :]
            elif found.start() >= start or mark == "```":
                held.append(mark)
        elif "```" in held:
            continue
        elif mark == "“" and "„" not in held or mark in "([{„«":
            if found.start() >= start:
                held.append(mark)
        elif (opening := CLOSING[mark]) in held:
            del held[len(held) - 1 - held[::-1].index(opening) :]
        elif mark == "»" and "»" not in held and "«" not in text:
            held.append("»")
    return any(mark != "»" for mark in held)


def judge(question: str | None, answer: str | None) -> tuple[list[str], str | None]:
    """Defects that the pair alone shows, and the ending that the corpus has to judge."""
    if answer is None or not ALNUM.search(answer):
        return ["empty"], None
    defects = []
    if question and _copied(question, answer):
        defects.append("copy")
    if REFUSAL.search(answer.lower().replace("’", "'")):
        defects.append("refusal")
    if question and _other_language(question, answer):
        defects.append("other_language")
    if OPEN_END.search(answer) or unclosed(answer):
        return [*defects, "truncated"], None
    return defects, last_key(answer)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, turns, found, endings, short = [], [], [], [], []
        for row_id, users, answers, present in zip(*(batch.column(c).to_pylist() for c in ("row_id", "user", "assistant", "present"))):
            if row_id is None:
                continue
            for turn, (question, answer, there) in enumerate(zip(users or [], answers or [], present or [])):
                if not there:
                    continue
                defects, ending = judge(question, answer)
                if defects or ending:
                    rows.append(row_id)
                    turns.append(turn)
                    found.append(defects)
                    endings.append(ending)
                    short.append(ending is not None and len(answer.split()) <= SHORT)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(turns, pa.int32()), pa.array(found, pa.list_(pa.string())), pa.array(endings, pa.string()), pa.array(short, pa.bool_())],
            ["row_id", "turn_idx", "defects", "ending", "short"],
        )


def cut_endings(counts: DataFrame) -> DataFrame:
    """ending, bare, cut, cut_short: the endings that stop short, of longer answers (cut) and of short ones.

    A lower-case word that hardly occurs inside texts is a fragment; a frequent one
    that never closes a sentence leaves it open. How often answers end with a word
    says nothing, so broken answers do not make themselves usual, however many there are.
    """
    inside = F.col("seen") - F.col("bare")
    fragment = F.col("ending").rlike(r"^\p{Ll}") & ~F.col("ending").endswith(" 0") & (inside <= F.col("bare"))
    never = (inside >= SUPPORT) & (F.col("stopped") < CLOSES * inside)
    return counts.where("bare > 0").select("ending", "bare", (fragment | never).alias("cut"), (fragment | never & (inside >= SUPPORT_SHORT) & (F.col("paused") < CLOSES_SHORT * inside) & ~F.col("ending").endswith(" 0")).alias("cut_short")).where("cut or cut_short")


def pair_defects(docs: DataFrame) -> DataFrame:
    """row_id, turn_idx, defect: every triggered defect type of every pair."""
    pairs = docs.where("row_id is not null").select("row_id", F.col("texts.user").alias("user"), F.col("texts.assistant").alias("assistant"), F.transform("texts", lambda t: t.isNotNull()).alias("present"))
    pairs = spread(pairs)
    judged = cut(pairs.mapInArrow(_judge, "row_id bigint, turn_idx int, defects array<string>, ending string, short boolean"))
    shown = judged.select("row_id", "turn_idx", F.explode("defects").alias("defect"))
    ends = cut(cut_endings(ending_counts(pairs.select("user", "assistant"))))
    asked = judged.where("ending is not null").select("row_id", "turn_idx", "ending", "short")
    # Of the endings that many answers share there are few: those are broadcast, the others joined by a shuffle.
    hot = lambda df: df.where(F.col("bare") >= HOT_ENDING)
    joined = asked.join(F.broadcast(hot(ends)), "ending").unionByName(asked.join(ends.where(F.col("bare") < HOT_ENDING), "ending"))
    truncated = joined.where(F.when(F.col("short"), F.col("cut_short")).otherwise(F.col("cut"))).select("row_id", "turn_idx", F.lit("truncated").alias("defect"))
    return shown.unionByName(truncated).distinct()


def first_defects(docs: DataFrame) -> DataFrame:
    """row_id, turn_idx, defect: of each defective pair the first type in the rules' order."""
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("defect"))
    return pair_defects(docs).groupBy("row_id", "turn_idx").agg(F.min_by("defect", rank).alias("defect"))
