"""Voters for abusive, threatening, hateful or sexually explicit language, and the reading of disguised words.

A word belongs to classes (it insults, names a group, is a verb of harm, a part of the body, ...). A voter looks at how
classes meet within a few words: a verb of harm with "you" after it, a group with what dehumanises, an insult with an
address. None is trusted by itself; how far each can be relied on is estimated from how they agree over all
documents. Most windows hold no word of a class that speaks of abuse and are passed by one look at their bits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

# Classes of words, English and Spanish, without accents. A star stands for any ending.
WORDS = {
    "you": "you your youre yours yourself yourselves u ur ya yall tu te ti tus usted ustedes vos vosotros eres sos",
    "me": "i me my mine im ill ive we us our mi mis yo nos nosotros",
    "third": "she he her him his hers hers",
    "insult": "idiot* moron* imbecile* cretin* retard* bastard* bitch* asshole* arsehole* dumbass* jackass* dipshit* shithead* dickhead* fuckface fuckwit* motherfucker* cocksucker* scumbag* douchebag* "
              "douche dimwit* halfwit* nitwit* numbskull* dunce* imbecil* idiota* estupid* cabron* pendej* gilipollas capullo* mamon* culero* malnacid* baboso* tarad* zorra* puta puto putas putos hijueputa hdp "
              "wanker* tosser* twat* prick pricks cunt* whore* slut* skank* lowlife* scum dumbfuck* shitbag* bellend* knobhead* pajer* maricon* mamahuevo* imbesil* lameculos subnormal* mongolic*",
    "mild": "fool fools clown clowns pig pigs leech* parasite* vermin loser* liar* crook* thief thieves fraud* creep creeps pervert* freak* weirdo* coward* hag swine turd maggot* "
            "crybaby brat disgrace inutil* payas* cerd* ladron* mentiros* cobarde* asco escoria ignorante* sinverguenza* parasito* lacra",
    "beast": "dog dogs cow cows rat rats snake snakes worm worms weasel* monkey* ape apes jackal* mule trash garbage rubbish filth joke waste sack bum bums burro burra bruto bruta perro perros perra rata ratas basura bestia* animal",
    "swear": "fuck* shit* bullshit crap crappy damn damned goddamn* piss* arse ass bollocks wtf stfu gtfo kys foad mierda* joder jodid* joda jodete chinga* pinche* carajo cojones cono hostia verga cagada cagar*",
    "negative": "stupid stupider stupidest dumb dumber dumbest idiotic moronic brainless mindless clueless useless worthless pathetic disgusting filthy ugly fat lazy incompetent retarded braindead spineless miserable rotten vile "
                "disgraceful lying dirty greedy ignorant inferior revolting repulsive worst sick subhuman crooked stinking sucio* asqueros* maldit* inutil* patetic* repugnante* feo fea gord* vago vaga podrid* miserable* ignorante* despreciable*",
    "slur": "nigger* nigga* kike* spic spics wetback* chink* gook* faggot* fag fags dyke* tranny trannies towelhead* raghead* sandnigger* beaner* coon coons paki pakis gypo* darkie* honky redskin* mongoloid* tard tards libtard* sudaca* "
            "moro moros panchito* negrata* bollera* travelo* marica* gringo* camelfucker* jap japs halfbreed*",
    "group": "muslim* islam* jew jews jewish black blacks asian* mexican* latino* latina* hispanic* african* arab* indian* chinese haitian* cuban* puerto immigrant* migrant* refugee* foreigner* foreign alien aliens gypsy gypsies gay gays lesbian* "
             "homosexual* queer* trans transgender* cripple* disabled handicapped autistic deaf blind women woman females female men elderly old religion* accent* christian* catholic* hindu* protestant* atheist* "
             "musulman* judi* inmigrante* extranjer* gitan* negr* refugiad* mexican* mujeres chin0* chino* arabe* african* sordo* ciego* discapacitad* haitian* indios",
    "people": "people kind kinds lot folks they them their these those everyone all every gente ellos esos esas estos todos todas son",
    "dehumanise": "vermin rats rat animal* trash filth cockroach* roach* disease* plague* subhuman* savage* parasite* leech* scum infest* breed* bred cancer garbage monkey* ape apes inferior pest pests cattle beasts monsters rubbish sewage "
                  "basura plaga* ladrones ratas animales cerdos cucaracha* escoria salvaje* alimana* sabandija* lacra* cage cages zoo jaula* criminals thieves rapists terrorists",
    "expel": "deport* ban banned expel* shipped kicked thrown exterminat* gas gassed eradicat* wipe wiped purge* cleans* invade* invading replacing "
             "echarlos echarlas echar expuls* deporta* sacarlos prohibir fuera",
    "harm": "kill* murder* shoot* shot stab* strangl* chok* beat* smash* burn* break* broke cut hurt hang hung slit bury bomb* punch* slap* hit crush* destroy* rip gut cripple slaughter* torture* drown* poison* attack* skin whip* knock* slice slash* "
            "matar* mato mate romper* rompo quemar* quemo golpe* partir* parto reventar* reviento ahorcar* disparar* apunal* degoll* lastimar* pegar* envenen*",
    "body": "neck legs leg face head skull throat teeth bones bone knees kneecaps fingers jaw ribs eyes brains arms hands car house home windows door family kids children wife husband office cara cuello piernas cabeza dientes huesos casa coche familia hijos garganta",
    "weapon": "gun guns knife knives bat bullet* rope noose axe hammer grenade rifle pistol blade brick shotgun baseball pistola cuchillo bala balas bate machete soga navaja fire fuego gasoline",
    "death": "die dies died dead death dying rot rots suffer* bleed* perish* hell coffin grave funeral suicide morir* muer* infierno tumba pudr* sangr* suicid* cancer tombstone morgue",
    "wish": "hope wish pray want deserve* better should ought need ojala espero deseo mereces merece merecen quiero",
    "stalk": "live lives sleep sleeps park parks follow* watch* find found wait* outside behind address know visit coming come track* vives vive donde seguir* esper* encontr* se",
    "sexbody": "breast* tits tit titties boobs boob ass asses butt cock cocks dick dicks penis pussy vagina clit nipple* thigh* crotch balls cum cunt groin erection boner cleavage tetas tetitas culo verga polla pene vagina chocha cono pezon* muslos nalgas trasero senos panocha pito",
    "sexverb": "suck* lick* fuck* bang* screw* ride rides riding strip strips stripping undress* grope* groping fondl* moan* thrust* penetrat* masturbat* jerk* finger* bend bent spread* kiss* touch* caress* grind* mount* taste tasting squeez* swallow* "
               "rub rubbing pound* straddl* spank* slide sliding press* pushed begg* chupa* chupar* lamer* lamo coger* cogerte follar* follarte tirarte besar* tocar* tocarte acariciar* montar* mont* gem* desnud* desvest* manosear* mamar* mamarme",
    "arousal": "horny aroused naked nude nudes topless sexy sex orgasm* porn porno blowjob* handjob* xxx threesome* lustful slutty naughty kinky desnud* cachond* sexo sexi excitad*",
    "garment": "bra bras panties panty blouse clothes shirt skirt underwear lingerie dress thong robe pants bikini ropa blusa falda bragas tanga calzones sujetador vestido",
    "picture": "pic pics picture* photo* video* selfie* cam webcam foto* fotito* videito* imagen* show send wearing wear imagine dream* ensena* muestra* mandame manda enviame envia lleva* puesto",
    "place": "bed bedroom room hotel lap desk knees couch shower cama habitacion rodillas regazo ducha",
    "mind": "brain* brains iq mind skull sense cell cells smarts intelligence cerebro neurona* inteligencia seso* head cabeza",
    "lack": "no without zero empty half small single missing lacking tiny never nothing none single dead low sin poco ningun nada vacio cero",
    "animal": "dog monkey ape goldfish toddler child donkey parrot potato brick rock hamster cat chicken chimp baby kindergartner kid mono perro burro nino loro piedra ameba",
    "compare": "could can smarter better brighter more faster would than knows mejor mas podria puede sabe que",
    "away": "shut piece pedazo hijo yours bugger sod lost away crawl drop disappear screw off lick kiss bite eat shove hell callate callese callense calla largate larguese vete vayase vayanse diablo piss",
    "report": "report* complain* complaint* training trained policy policies conduct harass* discriminat* incident* investigat* hotline zero tolerance disciplin* witness* alleg* slogan guideline* prohibited unacceptable inappropriate abusive "
              "counsel* survey article news court victim* awareness prevention prevent workshop seminar queja* reporto denuncia* acoso politica conducta incidente capacitacion",
    "medical": "cancer screening exam exams examen* mammogram* prostate colonoscopy dysfunction therap* surgery surgical nurse doctor* diagnos* clinic* hospital* prescription* medication* symptom* urgent biopsy pregnan* "
               "medical treatment* gynecolog* urolog* dermatolog* tumor patient* injury injuries allerg* infection ultrasound cyst cirugia medico mamografia tratamiento operar counseling counselling",
    "technical": "process processes task tasks batch server database script scripts deadline* query bug bugs thread* port log table backup network printer color colour ink staging scheduler "
                 "estimate invoice cable budget market traffic weather river flood* beaver* dam data",
    "polite": "please thanks thank appreciate sorry kindly respectfully gracias favor disculpe perdon respeto saludos regards",
    "dull": "thick dense slow sharpest stupid dumb iq brain* who",
    "worthless": "nothing nobody joke disgrace waste shame ashamed amount sick hate odio asco sirves vales sirven worth",
    "iwill": "voy vamos",
    "suffer": "regret* pay sorry bleed suffer* beg wish* hope back dead last eye coming deserve* days arrepentir arrepentiras pagar cuidate muert* numbered ojala come wake",
    "lonely": "nobody noone world favor favour jump kys matate suicidate rope aborted life down drowned nadie",
    "home": "back country welcome place english human belong* full race power gas heil jungle came home pais regresen vuelvan fuera",
    "intimate": "top inside body alone moan* scream* wet cum sex lap face bed cama knees",
    "hot": "hard wet horny hot aroused turned turn turns caliente cachond* excitad* mojad*",
    "curves": "lips lip legs body chest feet curves skin tongue hips labios piernas cuerpo pecho",
    "self": "feel felt feeling myself mistake oops silly confused embarrassed siento",
}
#: Words that disguises are resolved to: what insults, swears, threatens or is sexual.
_RESOLVED = ("insult", "swear", "slur", "negative", "sexbody", "dehumanise")
_MORE = "kill die murder whore sex suck lick moan strip ride nude naked horny fag hate stupid regret vermin panties"
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})
#: Letters of other scripts that look like Latin ones.
_TWINS = str.maketrans("асеіїорхуѕјкмнтвԁгӏαορν", "aceiiopxysjkmhtbdrlaopv")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")

BIT = {name: 1 << k for k, name in enumerate(WORDS)}
_EXACT: dict[str, int] = {}
_PREFIX: dict[str, int] = {}
for _name, _text in WORDS.items():
    for _w in _text.split():
        _where = _PREFIX if _w.endswith("*") else _EXACT
        _where[_w.rstrip("*")] = _where.get(_w.rstrip("*"), 0) | BIT[_name]
@lru_cache(maxsize=400_000)
def classes(word: str) -> int:
    """Bits of the classes a word belongs to. A compound such as fool-proof belongs to none."""
    if word.endswith(("-proof", "-free", "-safe")):
        return 0
    word = word.replace("-", "")
    bits = _EXACT.get(word, 0)
    for n in range(3, len(word) + 1):
        bits |= _PREFIX.get(word[:n], 0)
    return bits


_KNOWN = sorted({w.rstrip("*") for c in _RESOLVED for w in WORDS[c].split()} | set(_MORE.split()))
_KNOWN_SET = set(_KNOWN)


def _known(word: str) -> str:
    """The word itself, or with drawn-out letters shortened, if it is one that disguises are resolved to; else ''."""
    for w in (word, re.sub(r"(.)\1{2,}", r"\1", word), re.sub(r"(.)\1{2,}", r"\1\1", word), re.sub(r"(.)\1+", r"\1", word)):
        for end in ("", "s", "es", "ing", "ed", "er"):
            if w in _KNOWN_SET or (end and w.endswith(end) and w[: -len(end)] in _KNOWN_SET):
                return w
    return ""


@lru_cache(maxsize=400_000)
def reveal(token: str) -> str:
    """A token with look-alike signs read as letters, spelling dots removed, and masked words restored."""
    core = token.strip(".,;:?\"'()[]{}<>…¿¡“”‘’")
    bare = re.sub(r"!+$", "", core)
    if re.fullmatch(r"[a-z]+(?:['’-][a-z]+)*", bare):
        word = re.sub("['’]", "", bare)
        return (_known(word) or word) if re.search(r"(.)\1", word) and not classes(word) else word
    if not core or re.fullmatch(r"[$€]?[\d.,/%:-]+|[a-z]\d{4,}", core):
        return "0" if core else ""
    for form in dict.fromkeys((core, bare)):  # a final '!' may be a letter or a shout
        if m := re.fullmatch(r"([a-z]+)([.*#_-]{1,9})([a-z]+)", form):
            if len(set(m[2])) == 1 and len(m[2]) > 1 or m[2] in "*#":
                fits = [w for w in _KNOWN for w in (w, w + "s", w + "ing", w + "er") if len(w) == len(form) and w.startswith(m[1]) and w.endswith(m[3])]
                if fits:
                    return fits[0]
        letters = re.sub(r"[^a-z]", "", form.translate(_LEET))
        if word := _known(letters):
            return word
    if re.search(r"[a-z]", bare):
        return re.sub(r"[^a-z-]", "", bare.translate(_LEET)) or "0"
    return "0" if re.search(r"\d", bare) else ""


# A segment ends with a sentence, a picture sign, or at a line end or wide gap after which no small letter goes on. The
# pattern begins with signs only, which lets the engine skip ordinary letters.
SEGMENT = re.compile(r"[.!?…]\s+|[\r\n]+(?![a-zà-ÿ])|\s{2,}(?![a-zà-ÿ])|[\U0001F300-\U0001FAFF]")
_GAPPED = re.compile(r"\b[^\W\d_](?:[ \t]{1,3}[^\W\d_]){2,}\b")
WINDOW, STRIDE = 12, 6


def _plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    flat = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))
    return "".join(c for c in flat if not unicodedata.combining(c)).lower().translate(_TWINS)


def _respelt(m: re.Match) -> str:
    """Single letters with gaps between them, joined; an article or a known word in front of a known one stays apart."""
    word = re.sub(r"\s", "", m[0])
    low = word.lower()
    if _known(low):
        return word
    cut = next((k for k in range(1, len(low)) if (k > 2 or low[:k] in "ai") and _known(low[k:]) and (k <= 2 or _known(low[:k]))), 0)
    return f"{word[:cut]} {word[cut:]}" if cut else word


def segments(text: str | None) -> list[str]:
    """The segments of a whole text, words that are spelt out with gaps joined."""
    if not text:
        return []
    text, out, at = _GAPPED.sub(_respelt, text), [], 0
    for m in SEGMENT.finditer(text):
        out.append(text[at : m.end()].strip())
        at = m.end()
    out.append(text[at:].strip())
    return [s for s in out if s]


def words_of(segment: str) -> list[str]:
    return [w for w in map(reveal, _plain(segment).split()) if w]


def ranges(n: int) -> list[tuple[int, int]]:
    """Where the overlapping windows of a segment of n words begin and end."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    return [(a, a + WINDOW) for a in (*range(0, n - WINDOW, STRIDE), n - WINDOW)]


def windows(text: str | None) -> list[str]:
    """Overlapping runs of cleaned words from every segment of the whole text, each once."""
    out: dict[str, None] = {}
    for seg in segments(text):
        words = words_of(seg)
        for a, b in ranges(len(words)):
            out[" ".join(words[a:b])] = None
    return list(out)


# voters ------------------------------------------------------------------------------------------------------
def has(*names: str) -> Callable:
    """Words of all these classes."""
    need = sum(BIT[n] for n in names)
    return lambda t, w, m: all(any(x & BIT[n] for x in m) for n in names) if need else False


def near(first: str, then: str, within: int, either: bool = False) -> Callable:
    """A word of the first class, and one of the other at most so many words after it (or on either side)."""
    a, b = BIT[first], BIT[then]

    def test(t, w, m):
        for i, x in enumerate(m):
            if x & a:
                if any(y & b for y in m[i + 1 : i + 1 + within]) or (either and any(y & b for y in m[max(0, i - within) : i])):
                    return True
        return False

    return test


def says(pattern: str) -> Callable:
    rx = re.compile(rf"\b(?:{pattern})\b")
    return lambda t, w, m: rx.search(t) is not None


def either(*tests: Callable) -> Callable:
    return lambda t, w, m: any(f(t, w, m) for f in tests)


def both(*tests: Callable) -> Callable:
    return lambda t, w, m: all(f(t, w, m) for f in tests)


def alt(*names: str, but: tuple[str, ...] = ()) -> str:
    """The words of classes as alternatives of a pattern."""
    return "|".join(w.rstrip("*") + ("[a-z]*" if w.endswith("*") else "") for n in names for w in WORDS[n].split() if w not in but)


_YOU = r"(?:you|your|yours|ur|u|yall)"
_WILL = r"(?:will|ll|ill|gonna|going to|am going to|want to|wanna|should|swear|promise|would|could|might|voy a|vamos a)"
_BE = r"(?:are|re|is|were|be|being|act like|sound like|look like|eres|son|es|sos)"
#: Name; what firing speaks for (2 abuse, by how words meet, 1 abuse, by words alone, 0 clean); of what class; test.
CLASSES = ("clean", "insult", "threat", "hate", "sexual")
VOTERS = (
    ("insult_word", 2, "insult", has("insult")),
    ("swear_word", 1, "insult", has("swear")),
    ("negative_word", 1, "insult", has("negative")),
    ("mild_word", 1, "insult", has("mild")),
    ("insult_to_you", 2, "insult", near("insult", "you", 5, True)),
    ("insult_alone", 2, "insult", lambda t, w, m: len(w) <= 4 and any(x & (BIT["insult"] | BIT["slur"]) for x in m) and not any(x & (BIT["self"] | BIT["report"]) for x in m)),
    ("swear_at_you", 2, "insult", either(near("swear", "you", 2), says(r"(?:fuck|screw|damn|piss|sod|bugger) (?:off|you|u|yourself|your)|shut (?:the|your) \w+(?: up| mouth)?|kiss my|eat (?:shit|crap|dirt)|up yours|go fuck|piece of (?:shit|crap|trash|garbage)|pedazo de|hijo de|chinga tu|vete a la|que te jodan|a la mierda"))),
    ("negative_with_insult", 2, "insult", near("negative", "insult", 2)),
    ("negative_with_mild", 1, "insult", either(near("negative", "mild", 2), near("negative", "beast", 2), near("swear", "beast", 2))),
    ("you_are_negative", 2, "insult", says(rf"{_YOU} {_BE} (?:all |such |just |so |really |too |the |a |an |nothing but |one |as |most |muy |mas |un |una |tan |unos |unas )*(?:{alt('negative', 'mild', 'insult', 'beast')})|(?:eres|son|sos) (?:un |una |unos |unas |tan |muy |mas |todos )*(?:{alt('negative', 'mild', 'insult', 'beast')})")),
    ("negative_you_people", 2, "insult", says(rf"(?:{alt('negative')}) (?:little |old |excuse |{_YOU} |lot |bunch )?(?:of|for|agent|agents|people|person|company|staff|man|woman|human|lot)")),
    ("mind_attack", 2, "insult", either(both(near("lack", "mind", 3), has("you")), says(rf"(?:brain|iq|mind|intelligence) of an?|too (?:stupid|dumb|thick|slow) (?:to|for)|how (?:stupid|dumb|thick|dense|slow) (?:can|are|is|do)|as (?:dumb|thick|dense|stupid) as|not the sharpest|room temperature iq|use your brain|who (?:hired|trained) (?:you|such)"))),
    ("beast_to_you", 2, "insult", either(says(rf"{_YOU} (?:\w+ ){{0,2}}?(?:{alt('beast')})(?: |$)"), near("mild", "you", 3, True))),
    ("worse_than_animal", 2, "insult", both(near("animal", "compare", 3), has("compare"), says(rf"(?:an?|my|the|any|un|una|mi|cualquier) (?:\w+ )?(?:{alt('animal')}) (?:could|can|would|has|is|knows|does|podria|puede|sabe|lo) "))),
    ("worthless_to_you", 2, "insult", says(rf"you(?:re| are) (?:nothing|a nobody|a joke|a disgrace|a waste|worth nothing|not worth)|waste of (?:space|air|oxygen|skin|time)|good for nothing|no (?:sirves|vales|sirven)|ashamed of yourself|shame on you|never amount to|makes? me sick|sick of (?:you|your)|hate (?:you|your guts)|te odio|me das asco|das asco")),
    ("ordered_away", 2, "insult", says(r"shut (?:up|it)|(?:shove|stick|stuff) (?:it|that|your)|get lost|drop dead|go (?:to hell|away and|die|rot)|crawl (?:back )?(?:in|under|into)|disappear (?:for good|forever|already)|bite me|get out of my (?:face|sight)|never (?:speak|call|talk) to me|callate|callese|largate|vete al|vayanse al|burn in hell|rot in hell|stfu|gtfo")),
    ("harm_to_you", 2, "threat", says(rf"(?:i|we|ill|im|well|somebody|someone|my \w+|he|they) (?:{_WILL} )?(?:\w+ ){{0,3}}?(?:{alt('harm')}) (?:the \w+ out of )?(?:{_YOU}|every one of you|all of you|them all|te)|te voy a \w+|te (?:mato|rompo|quemo|parto|reviento)|los voy a \w+")),
    ("harm_near_body", 1, "threat", both(near("harm", "body", 4), near("harm", "you", 4, True))),
    ("harm_your_body", 2, "threat", says(rf"(?:{alt('harm')}) (?:\w+ )?(?:your|ur|tu|tus|su|la|las|el) (?:\w+ )?(?:{alt('body')})|(?:in|through|into|across|to|at|around) your (?:{alt('body')})")),
    ("weapon_near_you", 2, "threat", either(both(near("weapon", "you", 6, True), either(has("me"), has("harm"), has("stalk"), has("death"))), says(rf"(?:come|coming|came|show up|be there|bring\w*|grab|get|fetch|have|got|load\w*) (?:\w+ ){{0,3}}?(?:a|an|my|the|some|un|una|mi) (?:\w+ )?(?:{alt('weapon')})"))),
    ("you_will_suffer", 2, "threat", says(rf"you(?: will|ll|re going to| are going to| better| gonna|re gonna| shall| wont| will not)? (?:regret|pay for|be sorry|bleed|suffer|beg|wish you|never see|not live|wake up|live to)|watch your back|you(?:re| are) dead|dead (?:man|woman|meat)|(?:one|your) (?:last|night|eye) (?:day|open|you)|make you (?:pay|suffer|bleed|cry|sorry)|come for you|coming for you|get what you deserve|what is coming to you|whats coming to you|te (?:vas a|vas) arrepentir|lo vas a pagar|vas a pagar|cuidate|estas muert[oa]|count your days|days are numbered")),
    ("stalks_you", 2, "threat", either(says(r"(?:know|found|find|see|watch|saw|follow|se|sabemos|wait|waiting|be) (?:\w+ )?(?:out )?(?:where|which|when|how|what|donde|outside|for) (?:\w+ ){0,2}?(?:you|your|vives|trabajas|duermes)(?: \w+)? ?(?:live|lives|work|park|parks|sleep|car|house|home|office|kids|school|family)?|follow you home|where you (?:live|sleep|work|park)|outside your|at your (?:house|door|home)|donde vives|i will find you|ill find you"))),
    ("death_wish", 2, "threat", either(both(near("wish", "death", 5), has("you")), says(r"hope (?:you|your|they|he|she) (?:\w+ )?(?:die|dies|rot|rots|choke|burn|suffer|get cancer|get hit|never wake|crash|bleed)|ojala (?:te|se|que te) \w+|wish you were (?:dead|never born)|better off dead|deserve to (?:die|rot|suffer|burn)|should (?:all )?(?:die|be shot|be hanged|be dead|be put down|hang)|muerete|put you down"))),
    ("self_harm_pushed", 2, "threat", says(r"(?:kill|hang|shoot|drown|cut|off) (?:yourself|urself|yourselves)|kys|end your (?:life|own)|jump off|do (?:us|everyone|the world) (?:all )?a favor|(?:nobody|no one|noone)(?: \w+)? would (?:miss|care|notice)|world (?:would|is|will) be (?:\w+ )?better|slit your (?:wrists|throat)|find a rope|been (?:put down|aborted|drowned)|put (?:you|them) down|matate|suicidate|nadie te extranaria")),
    ("threat_words", 1, "threat", both(has("harm", "you"))),
    ("slur", 2, "hate", has("slur")),
    ("group_dehumanised", 2, "hate", near("group", "dehumanise", 7, True)),
    ("group_demeaned", 1, "hate", either(near("negative", "group", 2), near("group", "negative", 4), near("group", "mild", 4, True), near("swear", "group", 2))),
    ("group_expelled", 1, "hate", near("group", "expel", 7, True)),
    ("those_people", 2, "hate", both(says(r"(?:your|their|that|those|these|esa|ese|esos) (?:kind|people|sort|race|religion|lot|type|gente|raza)|you people|people like (?:you|them|that)|gente como|all of them|the whole lot|(?:they|these people|those people|you people) (?:are all|all|always|never|only|just|should|do nothing but)|ellos son"), either(has("negative"), has("dehumanise"), has("expel"), has("mild"), has("swear"), has("lack")))),
    ("back_where_from", 2, "hate", says(r"(?:go|went|send|sent|ship|shipped|get|belong|vuelv\w+|regres\w+|vayan\w*)(?: \w+)? (?:back|home) (?:\w+ )?(?:where|to (?:your|their|africa|mexico|china|the jungle)|from)|back (?:to )?where (?:you|they) came|where (?:you|they) came from|out of (?:our|my|this|the) country|not welcome here|(?:does not|do not|dont|doesnt|no place) belong|no place (?:in|for|here)|regresen a|vuelvan a su|fuera de (?:mi|nuestro|este) pais|speak english|not (?:even )?human|belongs? in (?:a|the) (?:cage|zoo|jungle|kitchen|gutter)|full of you|too (?:dumb|stupid|lazy|thick) to|coverage for (?:animals|vermin|trash)|less than human|master race|white power|gas the|inferior race|heil")),
    ("group_generalised", 2, "hate", says(r"(?:all|every|most|those|these|you|the|los|las|esos|todos los) (?:\w+ )?(?:" + alt("group", but=("old", "men", "alien", "aliens", "puerto", "religion*", "accent*", "elderly", "foreign")) + r") (?:\w+ ){0,2}?(?:are|should|deserve|steal|ruin|lie|cheat|breed|smell|stink|cannot|can not|never|only|live off|son|deben|roban|mienten|no merecen)(?: \w+){0,4}")),
    ("group_refused", 2, "hate", both(has("group"), says(r"(?:do not|dont|never|will not|wont|refuse to|no quiero|not) (?:\w+ )?(?:want|assign|let|allow|talk|speak|trust|hire|deal|serve|que me)|keep (?:\w+ ){0,4}(?:away|out)|since you (?:let|hire\w*|took)|rid of|need (?:more|less|fewer)|tired of|why do you (?:let|hire)|infest\w*|taking over|hands off"), either(has("negative"), has("dehumanise"), has("expel"), has("mild"), has("people")))),
    ("hate_of_group", 2, "hate", both(has("group"), says(r"hate (?:all |every |these |those |your |the )?\w+|odio a|despise|cant stand|sick of (?:these|those|all|your)|disgust me|make me sick|me dan asco|no soporto|filthy (?:religion|accent|hands|kind)|born (?:liars|thieves|criminals)|too (?:dumb|stupid|lazy) (?:to|for)"))),
    ("sex_body", 1, "sexual", has("sexbody")),
    ("arousal_word", 1, "sexual", has("arousal")),
    ("sex_acts", 2, "sexual", both(has("sexverb"), either(has("sexbody"), has("arousal")), either(has("you"), has("me"), has("third")))),
    ("your_sex_body", 2, "sexual", says(r"(?:your|my|her|his|ur|tu|tus|mi|mis|sus|those|that|nice|sweet|tight|hot|big) (?:\w+ ){0,2}?(?:" + alt("sexbody", but=("breast*", "balls")) + ")")),
    ("undress_for_me", 2, "sexual", both(either(has("garment"), has("arousal"), says(r"take (?:it|them|that|everything) off|clothes off|strip for|undress|naked|without (?:your|any) clothes|sin ropa|quitate|desnud\w+")), either(has("you"), has("me")), either(says(r"(?:take|slip|rip|tear|get|pull|quit\w+|wearing|under|off|for me|show|without|sin|imagine|out of|look\w* (?:good|great|hot|better)|puesto)"), has("sexverb")))),
    ("picture_wanted", 2, "sexual", both(near("picture", "you", 8, True), either(has("sexbody"), has("arousal"), has("garment"), has("place")))),
    ("picture_of_nakedness", 2, "sexual", both(has("picture"), either(has("arousal"), near("picture", "sexbody", 6), says(r"(?:show|send|ensename|muestrame|mandame) (?:me )?(?:\w+ ){0,2}?(?:of )?(?:your|tu|tus) (?:\w+ ){0,2}?(?:lips|legs|body|chest|feet|curves|skin|tongue|hips|labios|piernas|cuerpo|pecho)|(?:pic|picture|photo|foto)s? (?:of|de) (?:your|tu|tus) (?:lips|legs|body|chest|curves|piernas|cuerpo)")), says(r"(?:send|show|give|text|email|post|want|mand\w+|envi\w+|ensen\w+|muestr\w+) (?:me|us|over|a|an|some|more|your|una|tu)|mandame|enviame|ensename|muestrame"))),
    ("wants_you", 2, "sexual", says(r"(?:want|need|love|like|dying|wanna|going|quiero|me gustaria|let me|imagin\w+|think\w* (?:about|of)|dream\w* (?:about|of)) (?:\w+ ){0,3}?(?:taste|touch|feel|lick|kiss|fuck|ride|bend|undress|see|have|be|hold|squeeze|spank|tocarte|besarte|verte|tenerte|cogerte|comerte|lamerte|spread|strip|touching|kissing|riding) (?:\w+ ){0,2}?(?:you|your|naked|nude|desnuda|desnudo|me|in bed|on top|inside|en mi cama|sin ropa)|sit on my (?:face|lap)|bend you over|make you (?:moan|scream|wet|cum|come|beg)|come to my (?:room|place|hotel|bed)|in my bed|on top of (?:you|me)|inside (?:you|me)|all over (?:your|my|her|his) body|hands? all over|get you (?:naked|wet|alone)|ride me|suck (?:me|my|it|on)|on your knees|sleep with me|acuestate|have sex|sex with|touch(?:ing)? (?:myself|yourself)")),
    ("explicit_story", 2, "sexual", both(has("third"), has("sexverb"), either(has("sexbody"), has("arousal"), says(r"(?:her|his) (?:\w+ )?(?:lips|mouth|tongue|skin|body|hips|waist|neck|thighs|hair|chest|fingers|knees)|moan\w*|panting|begged|against (?:her|him|the wall)"), near("third", "garment", 3)))),
    ("arousal_by_you", 2, "sexual", both(either(has("you"), has("me")), says(r"(?:makes?|get|gets|getting|got|turn|turns|so|feel|how|me pones|pones|estoy) (?:me |you |myself )?(?:so |all |really |muy |bien |how )?(?:hard|wet|horny|hot|aroused|turned on|off|caliente|cachond\w|excitad\w|mojad\w)|horny|turn me on|(?:hard|wet) for (?:me|you|him|her)|(?:so|rock|getting|is|am|are) (?:\w+ )?(?:hard|wet) (?:right now|when|for|thinking|just)"))),
    ("calm_medical", 0, "clean", has("medical")),
    ("calm_technical", 0, "clean", has("technical")),
    ("calm_report", 0, "clean", has("report")),
    ("calm_polite", 0, "clean", has("polite")),
    ("calm_told", 0, "clean", says(r"(?:reported|complained|alleges?|claims?|explains?) that|(?:called|calling|calls|named|labeled|threatened|insulted|harassed|bullied|groped|accused) (?:me|her|him|them|us|my \w+|by|an? \w+|the \w+|of)|(?:she|he|they|coworker|caller|member|client|manager|employee|someone|somebody) (?:said|called|calls|yelled|threatened|used|told)|hr|police|lawsuit|court|le dijo|me dijo|lo llamo|la llamo")),
    ("calm_self", 0, "clean", says(r"(?:i|im|i am|i was|i feel|i felt|me siento|soy|fui) (?:\w+ ){0,3}?(?:idiot|stupid|dumb|fool|silly|clown|useless|moron|ignorant|tont[oa]|estupid[oa]|idiota)|my (?:bad|own|mistake)|stupid (?:question|mistake|me|thing|form|printer|password|of me|computer|phone|machine)|silly me|(?:idiot|fool)[ -]?proof|dummies")),
    ("calm_figure", 0, "clean", says(
        r"(?:killing|kills|killed|kill) (?:it|time|two|my (?:back|feet|knees|knee|hip|shoulder|head)|the (?:mood|deal|lights|engine|process|job|task|batch|switch|order|request|old)|me)|dying (?:to|for)|to die for|dead (?:line|end|battery|tired|serious|on|wrong|phone|line|heat|weight)|shoot (?:me|us|them|you|over) (?:an?|the|your)|shoot (?:for|the breeze|up)|break a leg|beat (?:the|last|our|my|that|this|around)|"
        r"hit (?:the|it|me|our|my|a|that|send|snooze|rate|by the)|bomb(?:ed)? (?:the|my|on)|murder on|bite the bullet|over my dead|dirty (?:read|data|bit|page|flag|laundry|work|dishes|clothes)|touch base|(?:website|site|form|portal|phone|printer|link|menu|screen|app|button|letter|answer) (?:is|was|are) (?:\w+ )?(?:useless|stupid|terrible|dumb)|worst (?:service|experience|case)|cut me|where you(?:re| are) coming from|hate (?:to|it when|mondays|paperwork|this (?:weather|traffic|form)|waiting|when)|damn (?:good|fine|nice|right|well)|killer (?:deal|price|app|view|recipe|presentation)|bloody mary|holy (?:crap|cow|smoke)|burn(?:ed|ing|t)? (?:out|calories|the toast|dinner|a cd|rubber|midnight)|"
        r"cut (?:the|my|our|your|back|off|costs|some|down|a check|me)|bury|rip(?:ped)? off|knock(?:ed)? (?:on|off|out)|cold turkey|guinea pig|rat race|piggy|black (?:friday|box|list|and white|ink|coffee|tea)|white (?:paper|board|noise|list)|old (?:plan|card|address|policy|file|man)|strip (?:mall|down|of|steak|club steak|the)|poker|bang for|screw(?:s|driver|ed in)|chicken breast|turkey breast|breast (?:cancer|feeding|exam|pump|screening|reconstruction)|pain in the|kick (?:off|the bucket|ass game)|hard (?:to|copy|time|work|of|drive|disk|deadline|hat)|wet (?:floor|weather|basement|paint|room|wipes)|hot (?:line|dog|water|lead|topic|flash)")),
)
#: Of which classes a window must hold a word for a voter to be asked at all: one of each group.
ASKED = {
    "insult_word": ("insult",), "swear_word": ("swear",), "negative_word": ("negative",), "mild_word": ("mild",), "insult_to_you": ("insult", "you"), "insult_alone": ("insult slur",), "swear_at_you": ("swear away",),
    "negative_with_insult": ("negative", "insult"), "negative_with_mild": ("negative swear", "mild beast"), "you_are_negative": ("negative mild insult beast", "you people"), "negative_you_people": ("negative",),
    "mind_attack": ("mind dull",), "beast_to_you": ("beast mild", "you"), "worse_than_animal": ("animal", "compare"), "worthless_to_you": ("worthless",), "ordered_away": ("away",), "harm_to_you": ("harm iwill", "you people"),
    "harm_near_body": ("harm", "body", "you"), "harm_your_body": ("body", "you people"), "weapon_near_you": ("weapon",), "you_will_suffer": ("suffer",), "stalks_you": ("stalk", "you"), "death_wish": ("death suffer", "wish suffer"),
    "self_harm_pushed": ("harm death lonely",), "threat_words": ("harm", "you"), "slur": ("slur",), "group_dehumanised": ("group", "dehumanise"), "group_demeaned": ("group", "negative mild swear"), "group_expelled": ("group", "expel"),
    "those_people": ("people", "negative dehumanise expel mild swear lack"), "back_where_from": ("home",), "group_generalised": ("group",), "group_refused": ("group", "negative dehumanise expel mild people"), "hate_of_group": ("group",),
    "sex_body": ("sexbody",), "arousal_word": ("arousal",), "sex_acts": ("sexverb", "sexbody arousal"), "your_sex_body": ("sexbody",), "undress_for_me": ("garment arousal sexverb", "you me"), "picture_wanted": ("picture", "you", "sexbody arousal garment place"),
    "picture_of_nakedness": ("picture", "arousal sexbody curves"), "wants_you": ("sexverb arousal place intimate", "you me"), "explicit_story": ("third", "sexverb"), "arousal_by_you": ("hot", "you me"),
}
_GROUPS = {name: tuple(sum(BIT[c] for c in g.split()) for g in groups) for name, groups in ASKED.items()}
_ABUSE = [(k, _GROUPS[v[0]], v[3]) for k, v in enumerate(VOTERS) if v[1]]
_CALM = [(k, v[3]) for k, v in enumerate(VOTERS) if not v[1]]


@lru_cache(maxsize=50_000)
def _asked(held: int) -> tuple:
    """The voters for abuse to ask about a window with words of these classes."""
    return tuple((k, test) for k, groups, test in _ABUSE if all(held & g for g in groups))


def votes_on(words: list[str], masks: list[int]) -> int:
    """Bit k is set where voter k fires on the window."""
    held, out = 0, 0
    for m in masks:
        held |= m
    asked = _asked(held)
    if asked:
        text = " ".join(words)
        for k, test in asked:
            if test(text, words, masks):
                out |= 1 << k
        if out:  # what speaks against abuse matters only where something speaks for it
            for k, test in _CALM:
                if test(text, words, masks):
                    out |= 1 << k
    return out


def votes(window: str) -> int:
    words = window.split()
    return votes_on(words, [classes(w) for w in words])
