"""Stemming by the published Snowball algorithms for English, German, French, Spanish, Portuguese, Italian, Dutch, Swedish,
Norwegian, Danish and Russian.

Other languages keep their words.

Words of letters only are stemmed; each distinct word of a batch is stemmed once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _longest(word: str, endings: tuple[str, ...], start: int = 0) -> str:
    """The longest of the endings (given longest first) within word[start:]."""
    if word.endswith(endings, start):  # most words have none, which one call tells
        for e in endings:
            if word.endswith(e, start):
                return e
    return ""


def _by_length(*endings: str) -> tuple[str, ...]:
    return tuple(sorted(endings, key=lambda e: (-len(e), e)))


# English

_EN_V = "aeiouy"
_EN_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
             **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}}
_EN_KEEP = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_EN_2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
         "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
_EN_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_EN_4 = _by_length("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _en_short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _EN_V and w[1] not in _EN_V
    return len(w) > 2 and w[-1] not in _EN_V + "wxY" and w[-2] in _EN_V and w[-3] not in _EN_V


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word.replace("’", "'").lstrip("'")
    if w in _EN_WHOLE:
        return _EN_WHOLE[w]
    w = re.sub(r"(?:^|(?<=[aeiouy]))y", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, _EN_V) if r1 is None else r1
    r2 = _region(w, _EN_V, r1)
    w = w[:len(w) - len(_longest(w, ("'s'", "'s", "'")))]
    e = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if e == "sses":
        w = w[:-2]
    elif e in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif e == "s" and any(c in _EN_V for c in w[:-2]):
        w = w[:-1]
    if w in _EN_KEEP:
        return w
    e = _longest(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[:-len(e)] + "ee"
    elif e and any(c in _EN_V for c in w[:-len(e)]):
        w = w[:-len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif r1 >= len(w) and _en_short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN_V:
        w = w[:-1] + "i"
    e = _longest(w, tuple(_EN_2))
    if e and len(w) - len(e) >= r1:
        if e == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif e == "li":
            w = w[:-2] if w[-3:-2] in tuple("cdeghkmnrt") else w
        else:
            w = w[:-len(e)] + _EN_2[e]
    e = _longest(w, tuple(_EN_3))
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[:-len(e)] + _EN_3[e]
    e = _longest(w, _EN_4)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[:-len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _en_short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# German

_DE_V = "aeiouyäöü"


def german(word: str) -> str:
    w = word.replace("ß", "ss")
    w = re.sub(f"(?<=[{_DE_V}])u(?=[{_DE_V}])", "U", w)
    w = re.sub(f"(?<=[{_DE_V}])y(?=[{_DE_V}])", "Y", w)
    r1 = _region(w, _DE_V)
    r2 = _region(w, _DE_V, r1)
    r1 = max(r1, 3)
    e = _longest(w, ("ern", "em", "er", "en", "es", "e", "s"))
    if e and len(w) - len(e) >= r1:
        if e != "s":
            w = w[:-len(e)]
            if e in ("en", "es", "e") and w.endswith("niss"):
                w = w[:-1]
        elif w[-2:-1] in tuple("bdfghklmnrt"):
            w = w[:-1]
    e = _longest(w, ("est", "en", "er", "st"))
    if e and len(w) - len(e) >= r1 and (e != "st" or (w[-3:-2] in tuple("bdfghklmnt") and len(w) >= 6)):
        w = w[:-len(e)]
    e = _longest(w, ("isch", "lich", "heit", "keit", "end", "ung", "ig", "ik"))
    if e and len(w) - len(e) >= r2:
        cut = w[:-len(e)]
        if e in ("end", "ung"):
            w = cut
            if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
                w = w[:-2]
        elif e in ("ig", "ik", "isch"):
            w = w if cut.endswith("e") else cut
        elif e in ("lich", "heit"):
            w = cut
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = cut
            f = _longest(w, ("lich", "ig"))
            if f and len(w) - len(f) >= r2:
                w = w[:-len(f)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


# Spanish

_ES_V = "aeiouáéíóúü"
_ES_PRONOUNS = _by_length("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
_ES_ACCENT = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir"}
_ES_1 = {
    **dict.fromkeys("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(), "cut"),
    **dict.fromkeys("adora ador ación adoras adores aciones ante antes ancia ancias".split(), "ic"),
    **dict.fromkeys("logía logías".split(), "log"), **dict.fromkeys("ución uciones".split(), "u"), **dict.fromkeys("encia encias".split(), "ente"),
    "amente": "amente", "mente": "mente", **dict.fromkeys("idad idades".split(), "idad"), **dict.fromkeys("iva ivo ivas ivos".split(), "iv"),
}
_ES_1_ENDINGS = _by_length(*_ES_1)
_ES_2A = _by_length(*"ya ye yan yen yeron yendo yo yó yas yes yais yamos".split())
_ES_2B_E = ("en", "es", "éis", "emos")
_ES_2B = _by_length(*"""arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis
    iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases
    ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos""".split(), *_ES_2B_E)


def _rv(word: str, vowels: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] in vowels), len(word))
    if word[0] in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in vowels), len(word))
    return 3


def spanish(word: str) -> str:
    w = word
    rv, r1 = _rv(w, _ES_V), _region(w, _ES_V)
    r2 = _region(w, _ES_V, r1)
    e = _longest(w, _ES_PRONOUNS, rv)
    if e:
        stem = w[:-len(e)]
        before = _longest(stem, _by_length("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"), rv)
        if before == "yendo":
            w = stem if stem.endswith("uyendo") else w
        elif before:
            w = stem[:-len(before)] + _ES_ACCENT.get(before, before)
    start = w
    e = _longest(w, _ES_1_ENDINGS)
    if e:
        kind, at = _ES_1[e], len(w) - len(e)
        if kind == "amente":
            if at >= r1:
                w = w[:at]
                f = _longest(w, ("iv", "os", "ic", "ad"), r2)
                if f:
                    w = w[:-2]
                    if f == "iv" and _longest(w, ("at",), r2):
                        w = w[:-2]
        elif at >= r2:
            w = w[:at] + {"log": "log", "u": "u", "ente": "ente"}.get(kind, "")
            more = {"ic": ("ic",), "mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "iv": ("at",)}.get(kind, ())
            w = w[:len(w) - len(_longest(w, more, r2))]
    if w == start:
        e = _longest(w, _ES_2A, rv)
        if e and w[:-len(e)].endswith("u"):
            w = w[:-len(e)]
        else:
            e = _longest(w, _ES_2B, rv)
            if e:
                w = w[:-len(e)]
                if e in _ES_2B_E and w.endswith("gu"):
                    w = w[:-1]
    e = _longest(w, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv)
    if e:
        w = w[:-len(e)]
        if e in "eé" and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(str.maketrans("áéíóú", "aeiou"))


# French

_FR_V = "aeiouyâàëéêèïîôûù"
_FR_1 = {
    **dict.fromkeys("ance iqUe isme able iste eux ances iqUes ismes ables istes".split(), "cut"),
    **dict.fromkeys("atrice ateur ation atrices ateurs ations".split(), "ic"), **dict.fromkeys("logie logies".split(), "log"),
    **dict.fromkeys("usion ution usions utions".split(), "u"), **dict.fromkeys("ence ences".split(), "ent"), **dict.fromkeys("ement ements".split(), "ement"),
    **dict.fromkeys("ité ités".split(), "ité"), **dict.fromkeys("if ive ifs ives".split(), "if"), "eaux": "eau", "aux": "al", **dict.fromkeys("euse euses".split(), "eux"),
    **dict.fromkeys("issement issements".split(), "iss"), "amment": "ant", "emment": "ent2", **dict.fromkeys("ment ments".split(), "ment"),
}
_FR_1_ENDINGS = _by_length(*_FR_1)
_FR_2A = _by_length(*"îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split())
_FR_2B_E = frozenset("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split())
_FR_2B_A = frozenset("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split())
_FR_2B = _by_length("ions", *_FR_2B_E, *_FR_2B_A)


def french(word: str) -> str:
    v = _FR_V
    w = re.sub(f"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), word)
    w = re.sub(f"y(?=[{v}])|(?<=[{v}])y", "Y", w)
    w = w.replace("qu", "qU")
    if len(w) > 1 and w[0] in v and w[1] in v or w.startswith(("par", "col", "tap")):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in v), len(w))
    r1 = _region(w, v)
    r2 = _region(w, v, r1)
    start, verbs = w, False
    e = _longest(w, _FR_1_ENDINGS)
    if e:
        kind, at = _FR_1[e], len(w) - len(e)
        if kind in ("cut", "ic", "log", "u", "ent") and at >= r2:
            w = w[:at] + {"log": "log", "u": "u", "ent": "ent"}.get(kind, "")
            if kind == "ic" and w.endswith("ic"):
                w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
        elif kind == "ement" and at >= rv:
            w = w[:at]
            if _longest(w, ("iv",), r2):
                w = w[:-2]
                w = w[:-2] if _longest(w, ("at",), r2) else w
            elif w.endswith("eus"):
                w = w[:-3] if len(w) - 3 >= r2 else w[:-1] + "x" if len(w) - 3 >= r1 else w
            elif _longest(w, ("abl", "iqU"), r2):
                w = w[:-3]
            elif _longest(w, ("ièr", "Ièr"), rv):
                w = w[:-3] + "i"
        elif kind == "ité" and at >= r2:
            w = w[:at]
            if w.endswith("abil"):
                w = w[:-4] if len(w) - 4 >= r2 else w[:-2] + "l"
            elif w.endswith("ic"):
                w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
            elif _longest(w, ("iv",), r2):
                w = w[:-2]
        elif kind == "if" and at >= r2:
            w = w[:at]
            if _longest(w, ("at",), r2):
                w = w[:-2]
                if w.endswith("ic"):
                    w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
        elif kind == "eau":
            w = w[:-1]
        elif kind == "al" and at >= r1:
            w = w[:-2] + "l"
        elif kind == "eux":
            w = w[:at] if at >= r2 else w[:at] + "eux" if at >= r1 else w
        elif kind == "iss" and at >= r1 and at > 0 and w[at - 1] not in v:
            w = w[:at]
        elif kind in ("ant", "ent2") and at >= rv:
            w, verbs = w[:at] + kind[:3], True
        elif kind == "ment" and at - 1 >= rv and w[at - 1] in v:
            w, verbs = w[:at], True
    if w == start or verbs:
        before = w
        e = _longest(w, _FR_2A, rv)
        if e and len(w) - len(e) - 1 >= rv and w[len(w) - len(e) - 1] not in v:
            w = w[:-len(e)]
        if w == before:
            e = _longest(w, _FR_2B, rv)
            if e == "ions":
                w = w[:-4] if len(w) - 4 >= r2 else w
            elif e in _FR_2B_E:
                w = w[:-len(e)]
            elif e:
                w = w[:-len(e)]
                if w.endswith("e") and len(w) - 1 >= rv:
                    w = w[:-1]
        changed = w != before or verbs
    else:
        changed = True
    if changed:
        w = w[:-1] + {"Y": "i", "ç": "c"}.get(w[-1:], w[-1:])
    else:
        if w.endswith("s") and w[-2:-1] not in tuple("aiouès"):
            w = w[:-1]
        e = _longest(w, ("ière", "Ière", "ier", "Ier", "ion", "e", "ë"), rv)
        if e == "ion":
            w = w[:-3] if len(w) - 3 >= r2 and len(w) - 4 >= rv and w[-4:-3] in ("s", "t") else w
        elif e in ("ier", "ière", "Ier", "Ière"):
            w = w[:-len(e)] + "i"
        elif e == "e" or (e == "ë" and w[-3:-1] == "gu"):
            w = w[:-1]
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(f"[éè](?=[^{v}]+$)", "e", w)
    return w.lower()


# Swedish, Norwegian, Danish: endings in the region after the first three letters at least

_SV_1 = _by_length(*"a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast s".split())
_NO_1 = _by_length(*"a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast erte ert s".split())
_NO_3 = _by_length(*"leg eleg ig eig lig elig els lov elov slov hetslov".split())
_DA_1 = _by_length(*"hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret s".split())
_DA_V = _NO_V = "aeiouyæåø"
_SV_V = "aeiouyäåö"


def _late_region(word: str, vowels: str) -> int:
    return max(_region(word, vowels), 3)


def swedish(word: str) -> str:
    w, r1 = word, _late_region(word, _SV_V)
    e = _longest(w, _SV_1, r1)
    if e and (e != "s" or w[-2:-1] in tuple("bcdfghjklmnoprtvy")):
        w = w[:-len(e)]
    if _longest(w, ("dd", "gd", "nn", "dt", "gt", "kt", "tt"), r1):
        w = w[:-1]
    e = _longest(w, ("fullt", "löst", "lig", "els", "ig"), r1)
    return w[:-1] if e in ("fullt", "löst") else w[:len(w) - len(e)]


def norwegian(word: str) -> str:
    w, r1 = word, _late_region(word, _NO_V)
    e = _longest(w, _NO_1, r1)
    if e in ("erte", "ert"):
        w = w[:-len(e)] + "er"
    elif e == "s":
        w = w[:-1] if w[-2:-1] in tuple("bcdfghjlmnoprtvyz") or w[-2:-1] == "k" and w[-3:-2] not in _NO_V else w
    elif e:
        w = w[:-len(e)]
    if _longest(w, ("dt", "vt"), r1):
        w = w[:-1]
    return w[:len(w) - len(_longest(w, _NO_3, r1))]


def danish(word: str) -> str:
    w, r1 = word, _late_region(word, _DA_V)
    e = _longest(w, _DA_1, r1)
    if e and (e != "s" or w[-2:-1] in tuple("abcdfghjklmnoprtvyzå")):
        w = w[:-len(e)]

    def short(w: str) -> str:
        return w[:-1] if _longest(w, ("gd", "dt", "gt", "kt"), r1) else w

    w = short(w)
    w = w[:-2] if w.endswith("igst") else w
    e = _longest(w, ("løst", "elig", "lig", "els", "ig"), r1)
    w = w[:-1] if e == "løst" else short(w[:-len(e)]) if e else w
    return w[:-1] if len(w) > r1 and w[-1] not in _DA_V and w[-2:-1] == w[-1] else w


# Russian

_RU_V = "аеиоуыэюя"
_RU_AFTER_A = {"gerund": ("в", "вши", "вшись"), "participle": ("ем", "нн", "вш", "ющ", "щ"), "verb": tuple("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split())}
_RU_FREE = {"gerund": ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись"), "participle": ("ивш", "ывш", "ующ"),
            "verb": tuple("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split())}
_RU_ENDINGS = {k: _by_length(*_RU_AFTER_A[k], *_RU_FREE[k]) for k in _RU_FREE}
_RU_ADJECTIVE = _by_length(*"ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split())
_RU_NOUN = _by_length(*"а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split())


def russian(word: str) -> str:
    w, r1 = word, _region(word, _RU_V)
    r2 = _region(w, _RU_V, r1)
    rv = next((i + 1 for i, c in enumerate(w) if c in _RU_V), len(w))

    def without(w: str, kind: str) -> str | None:
        """w without its longest ending of a kind; None if there is none, or what it must follow doesn't stand before it."""
        e = _longest(w, _RU_ENDINGS[kind], rv)
        if not e or e in _RU_AFTER_A[kind] and not (len(w) - len(e) > rv and w[-len(e) - 1] in "ая"):
            return None
        return w[:-len(e)]

    done = without(w, "gerund")
    if done is None:
        w = w[:len(w) - len(_longest(w, ("ся", "сь"), rv))]
        if e := _longest(w, _RU_ADJECTIVE, rv):
            w = w[:-len(e)]
            done = without(w, "participle")
            done = w if done is None else done
        else:
            done = without(w, "verb")
            done = w[:len(w) - len(_longest(w, _RU_NOUN, rv))] if done is None else done
    w = done
    w = w[:len(w) - len(_longest(w, ("и",), rv))]
    w = w[:len(w) - len(_longest(w, ("ость", "ост"), max(r2, rv)))]
    if e := _longest(w, ("ейше", "ейш"), rv):
        w = w[:-len(e)]
        return w[:-1] if _longest(w, ("нн",), rv) else w
    if _longest(w, ("нн", "ь"), rv):
        w = w[:-1]
    return w


# Portuguese

_PT_V = "aeiouáéíóúâêô"
_PT_PLAIN = _by_length(*"eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split())
_PT_OTHER = ("logia", "logias", "uça~o", "uço~es", "ência", "ências", "amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos", "ira", "iras")
_PT_1 = _by_length(*_PT_PLAIN, *_PT_OTHER)
_PT_2 = _by_length(*"""ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem
    ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis
    aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos
    êssemos íssemos imos armos ermos irmos eu iu ou ira iras""".split())


def _without(w: str, endings: tuple[str, ...], start: int) -> str:
    return w[:len(w) - len(_longest(w, endings, start))]


def portuguese(word: str) -> str:
    w = word.replace("ã", "a~").replace("õ", "o~")
    rv, r1 = _rv(w, _PT_V), _region(w, _PT_V)
    r2 = _region(w, _PT_V, r1)
    start, e = w, _longest(w, _PT_1)
    at = len(w) - len(e)
    if e in _PT_PLAIN and at >= r2:
        w = w[:at]
    elif e in ("logia", "logias") and at >= r2:
        w = w[:at] + "log"
    elif e in ("uça~o", "uço~es") and at >= r2:
        w = w[:at] + "u"
    elif e in ("ência", "ências") and at >= r2:
        w = w[:at] + "ente"
    elif e == "amente" and at >= r1:
        w = w[:at]
        w = _without(w[:-2], ("at",), r2) if _longest(w, ("iv",), r2) else _without(w, ("os", "ic", "ad"), r2)
    elif e == "mente" and at >= r2:
        w = _without(w[:at], ("ante", "avel", "ível"), r2)
    elif e in ("idade", "idades") and at >= r2:
        w = _without(w[:at], ("abil", "ic", "iv"), r2)
    elif e in ("iva", "ivo", "ivas", "ivos") and at >= r2:
        w = _without(w[:at], ("at",), r2)
    elif e in ("ira", "iras") and at >= rv and w[at - 1:at] == "e":
        w = w[:at] + "ir"
    if w == start:
        w = _without(w, _PT_2, rv)
    if w != start:
        w = w[:-1] if w.endswith("ci") and len(w) - 1 >= rv else w
    else:
        w = _without(w, ("os", "a", "i", "o", "á", "í", "ó"), rv)
    if _longest(w, ("e", "é", "ê"), rv):
        w = w[:-1]
        w = w[:-1] if w.endswith(("gu", "ci")) and len(w) - 1 >= rv else w
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


# Italian

_IT_V = "aeiouàèìòù"
_IT_PRONOUNS = _by_length(*"ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split())
_IT_PLAIN = _by_length(*"anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split())
_IT_1 = _by_length(*_IT_PLAIN, *"azione azioni atore atori logia logie uzione uzioni usione usioni enza enze amento amenti imento imenti amente ità ivo ivi iva ive".split())
_IT_2 = _by_length(*"""ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono
    essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate
    ivi ivo ono uta ute uti uto ar ir""".split())


def italian(word: str) -> str:
    w = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    w = re.sub(f"(?<=[{_IT_V}])[ui](?=[{_IT_V}])", lambda m: m[0].upper(), w)
    rv, r1 = _rv(w, _IT_V), _region(w, _IT_V)
    r2 = _region(w, _IT_V, r1)
    if e := _longest(w, _IT_PRONOUNS):
        base = w[:-len(e)]
        before = _longest(base, ("ando", "endo", "ar", "er", "ir"), rv)
        w = base if before in ("ando", "endo") else base + "e" if before else w
    start, e = w, _longest(w, _IT_1)
    at = len(w) - len(e)
    if e in ("amento", "amenti", "imento", "imenti"):
        w = w[:at] if at >= rv else w
    elif e == "amente":
        if at >= r1:
            w = w[:at]
            w = _without(w[:-2], ("at",), r2) if _longest(w, ("iv",), r2) else _without(w, ("abil", "os", "ic"), r2)
    elif e and at >= r2:
        if e in ("azione", "azioni", "atore", "atori"):
            w = _without(w[:at], ("ic",), r2)
        elif e in ("logia", "logie"):
            w = w[:at] + "log"
        elif e in ("uzione", "uzioni", "usione", "usioni"):
            w = w[:at] + "u"
        elif e in ("enza", "enze"):
            w = w[:at] + "ente"
        elif e == "ità":
            w = _without(w[:at], ("abil", "ic", "iv"), r2)
        elif e in ("ivo", "ivi", "iva", "ive"):
            w = w[:at]
            w = _without(w[:-2], ("ic",), r2) if _longest(w, ("at",), r2) else w
        else:
            w = w[:at]
    if w == start:
        w = _without(w, _IT_2, rv)
    if _longest(w, tuple("aeioàèìò"), rv):
        w = _without(w[:-1], ("i",), rv)
    if _longest(w, ("ch", "gh"), rv):
        w = w[:-1]
    return w.replace("U", "u").replace("I", "i")


# Dutch

_NL_V = "aeiouyè"


def dutch(word: str) -> str:
    w = word.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    w = re.sub(f"^y|(?<=[{_NL_V}])y", "Y", w)
    w = re.sub(f"(?<=[{_NL_V}])i(?=[{_NL_V}])", "I", w)
    r1 = _region(w, _NL_V)
    r2 = _region(w, _NL_V, r1)
    r1 = max(r1, 3)

    def single(w: str) -> str:
        return w[:-1] if w.endswith(("kk", "dd", "tt")) else w

    def without_en(w: str, e: str) -> str:
        at = len(w) - len(e)
        return single(w[:at]) if at >= r1 and w[at - 1:at] not in _NL_V and not w[:at].endswith("gem") else w

    def without_e(w: str) -> tuple[str, bool]:
        if w.endswith("e") and len(w) - 1 >= r1 and w[-2:-1] not in _NL_V:
            return single(w[:-1]), True
        return w, False

    e = _longest(w, ("heden", "ene", "en", "se", "s"))
    at = len(w) - len(e)
    if e == "heden":
        w = w[:at] + "heid" if at >= r1 else w
    elif e in ("en", "ene"):
        w = without_en(w, e)
    elif e and at >= r1 and w[at - 1:at] not in _NL_V + "j":
        w = w[:at]
    w, removed = without_e(w)
    if w.endswith("heid") and len(w) - 4 >= r2 and w[-5:-4] != "c":
        w = w[:-4]
        w = without_en(w, "en") if w.endswith("en") else w
    e = _longest(w, ("lijk", "baar", "end", "ing", "bar", "ig"))
    if e and len(w) - len(e) >= r2:
        base = w[:-len(e)]
        if e in ("end", "ing"):
            w = base[:-2] if _longest(base, ("ig",), r2) and base[-3:-2] != "e" else single(base)
        elif e == "ig":
            w = base if base[-1:] != "e" else w
        elif e == "lijk":
            w = without_e(base)[0]
        elif e == "baar" or removed:
            w = base
    if len(w) >= 4 and w[-4] not in _NL_V and w[-3:-1] in ("aa", "ee", "oo", "uu") and w[-1] not in _NL_V + "I":
        w = w[:-2] + w[-1]
    return w.replace("Y", "y").replace("I", "i")


STEMMERS = {"en": english, "de": german, "es": spanish, "fr": french, "sv": swedish, "no": norwegian, "da": danish, "ru": russian,
            "pt": portuguese, "it": italian, "nl": dutch}


@lru_cache(maxsize=200_000)
def stem(word: str, language: str | None) -> str:
    stemmer = STEMMERS.get(language or "")
    return stemmer(word) if stemmer and word.isalpha() or stemmer and "'" in word else word


def stemmed(tokens: Column, language: Column | str) -> Column:
    """The tokens' stems, in order. language: two letters, a column or one for all rows."""
    def of(words: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else [stem(x, lang) for x in w] for w, lang in zip(words, languages)])

    language = F.lit(language) if isinstance(language, str) else language
    return F.pandas_udf(of, "array<string>")(tokens, language)
