"""Tables and patterns that results depend on, stated as they must be."""

# Replacements of print artefacts, in order.
CHARACTER_FIXES = [
    ("ſ", "s"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ß", "ss"),
    ("‐", "-"), ("‑", "-"), ("‒", "-"), ("–", "-"), ("—", "-"),
    ("“", '"'), ("”", '"'), ("„", '"'), ("‟", '"'), ("«", '"'), ("»", '"'), ("‘", "'"), ("’", "'"), ("‚", "'"),
    ("…", "..."), ("­", ""), ("​", ""), ("﻿", ""),
]

# Spelling rules of a lower-case word, in order within a group; groups in the order core, germanisms, palatals.
CORE = [("tsch", "č"), ("dsch", "dž"), ("sch", "š"), ("zh", "ž"), ("eeh", "ie"), ("ee", "ie"), ("ah", "ā"), ("eh", "ē"), ("ih", "ī"), ("uh", "ū"), ("oh", "o"), ("w", "v"), ("z", "c")]
GERMANISMS = [("ck", "k"), ("ds", "dz"), ("th", "t"), ("ph", "f"), ("ch", "h"), ("y", "ī")]
PALATALS = [("nj", "ņ"), ("lj", "ļ"), ("kj", "ķ"), ("gj", "ģ")]
DOUBLED = "bcčdfgģklļmnņprsštvzž"
PREFIXES = "at ap aiz ie iz ne pa pār par pie sa uz no jaun".split()

# Spellings of a modern grapheme in old print, in order of trial.
OLD_SPELLINGS = [
    ("dž", ["dsch"]), ("ie", ["ee", "ie"]), ("š", ["sch", "sh", "ſch"]), ("ž", ["zh", "sh"]), ("č", ["tsch"]), ("dz", ["ds", "dz"]),
    ("ā", ["ah", "a"]), ("ē", ["eh", "e"]), ("ī", ["ih", "i", "y"]), ("ū", ["uh", "u"]), ("ō", ["oh", "o"]),
    ("ņ", ["nj", "n"]), ("ļ", ["lj", "l"]), ("ķ", ["kj", "k"]), ("ģ", ["gj", "g"]), ("c", ["z"]), ("v", ["w"]), ("z", ["s", "z"]), ("h", ["h", "ch"]),
]

# Marks of old spelling in a word, and their weights.
OLD_MARKS = [("sch|ſch", 1.0), ("tsch|dsch", 1.0), ("w", 0.9), ("[qxy]", 0.4), ("ee", 0.7), ("[aeiou]h(?![aeiouāēīū])", 0.7), ("ſ", 1.0), ("zh", 0.6)]
MODERN_MARK = "[āčēģīķļņšūž]"
MIXED_FROM, OLD_FROM = 0.12, 0.35

# Endings that stemming takes off.
SUFFIXES = """sanas sanai sanam sanos sana sanu ajiem ajam ajos ajas ajai aja ibas ibai ibam iba ibu usies ties usas usi usu uso
iem ies ams ots oti ota isi isu am as em es im is os us ai ei ie ju um a e i s u t""".split()

# Inflection endings by paradigm, and the paradigm that an ending shows, in order of trial.
PARADIGMS = {"a": "a as ai u ā ām ās", "e": "e es ei i ē ēm ēs", "s": "s a am u ā i iem os", "is": "is ja im i ī ji jiem jos", "us": "us um u ū i iem os", "t": "t ja ju s"}
ENDINGS = [("ties", "t"), ("iem", "s"), ("ām", "a"), ("ās", "a"), ("ēm", "e"), ("ēs", "e"), ("is", "is"), ("us", "us"), ("as", "a"), ("es", "e"), ("os", "s"), ("am", "s"), ("ai", "a"), ("ei", "e"), ("im", "is"), ("ā", "a"), ("ē", "e"), ("š", "s"), ("s", "s"), ("a", "a"), ("e", "e"), ("t", "t")]

# Stop-words by language, in the order in which ties are decided.
STOPWORDS = {
    "lv": """un ir ar par no uz pie pēc bez kas ka tas tā tie tās šis šī bet vai jau tikai arī viņš viņa mēs jūs es tu man tev nav būt bija būs kad kur kā ļoti daudz
    irr pee us arri tikkai wai winsch mehs wiſſi wissi tahs schi tee kaß nhe""".split(),
    "de": "der die das und den dem des ein eine einen ist sind war nicht für von mit auf aus im zu sich auch wird werden dass daß hat haben wie nur noch bei nach über er sie es wir ihr man schon aber".split(),
    "et": "ja on ei ning see kes oma aga ka siis kui tema meie teie olen oli ole kõik veel nüüd".split(),
}

# Beginnings of month names, tried in this order on five letters; folk names with the months they may mean.
MONTHS = [("janva", 1), ("febru", 2), ("mart", 3), ("april", 4), ("maij", 5), ("junij", 6), ("julij", 7), ("augus", 8), ("septe", 9), ("oktob", 10), ("novem", 11), ("decem", 12), ("janwa", 1), ("mahrt", 3), ("nowem", 11), ("dezem", 12)]
FOLK_MONTHS = [("ziemas", [1, 12]), ("svecu", [2, 1]), ("sersnu", [3]), ("sulu", [4]), ("lapu", [5]), ("ziedu", [6, 5]), ("siena", [7]), ("rudzu", [8]), ("silu", [9]), ("velu", [10, 11]), ("salnu", [11]), ("vilku", [12])]

# Places by modern name, with names of the time; _ stands for a blank within a name.
PLACES = {
    "Rīga": "Riga Rihga Рига", "Jelgava": "Mitau Jelgawa Митава", "Liepāja": "Libau Leepaja Либава", "Ventspils": "Windau Wentspils Виндава", "Kuldīga": "Goldingen Kuldiga Гольдинген",
    "Aizpute": "Hasenpoth Aispute Газенпот", "Grobiņa": "Grobin Grobina", "Tukums": "Tuckum Tukkums Туккум", "Talsi": "Talsen Talsi", "Kandava": "Kandau Kandawa", "Sabile": "Zabeln Sabile",
    "Piltene": "Pilten Piltene", "Durbe": "Durben Durbe", "Bauska": "Bauske Bauska Бауск", "Jaunjelgava": "Friedrichstadt Jaunjelgawa Фридрихштадт", "Jēkabpils": "Jakobstadt Jehkabpils Якобштадт",
    "Daugavpils": "Dünaburg Duenaburg Dinaburga Daugawpils Двинск Динабург", "Rēzekne": "Rositten Rehsekne Режица", "Ludza": "Ludsen Ludsa Люцин", "Krāslava": "Kreslawka Krahslawa Краслава",
    "Viļaka": "Marienhausen Wilaka", "Ilūkste": "Illuxt Iluhkste Иллукст", "Subate": "Subbath Subate", "Cēsis": "Wenden Zehsis Венден", "Valmiera": "Wolmar Walmeera Вольмар", "Valka": "Walk Walka Валк",
    "Limbaži": "Lemsal Limbaschi", "Ogre": "Oger Ogre", "Koknese": "Kokenhusen Koknese", "Pļaviņas": "Stockmannshof Plawinas", "Sloka": "Schlock Sloka", "Jūrmala": "Majorenhof Dubbeln Bilderlingshof Juhrmala",
    "Ķemeri": "Kemmern Kjemeri", "Alūksne": "Marienburg Aluhksne Мариенбург", "Gulbene": "Schwanenburg Gulbene", "Madona": "Modohn Madona", "Cesvaine": "Sesswegen Zeswaine", "Smiltene": "Smilten Smiltene",
    "Salaspils": "Kirchholm Salaspils", "Vidzeme": "Livland Lifland Widseme Лифляндия", "Kurzeme": "Kurland Kurseme Курляндия", "Zemgale": "Semgallen Semgale", "Latgale": "Latgola Inflantija Инфлянты",
    "Sēlija": "Selonien Sehlija", "Igaunija": "Estland Igaunija Эстляндия", "Tartu": "Dorpat Terbata Юрьев Дерпт", "Tallina": "Reval Rewele Ревель", "Pērnava": "Pernau Pernawa Пернов", "Viļņa": "Wilna Wilna Вильно",
    "Sanktpēterburga": "St._Petersburg Petersburga Pehterburga Петербургъ",
}

# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = "g. gs. gadsk. lpp. nr. sk. piem. t.i. t.s. u.c. u.tml. utt. u.t.t. dz. d. mēn. rbļ. kap. kg. km. m. cm. st. k-gs kgs prof. dr. inž. red. izd.".split()

# Strings that recognition confuses, either way, by script.
CONFUSED = {
    "common": [("f", "s"), ("ss", "ß"), ("ii", "n"), ("rn", "m"), ("cl", "d"), ("l", "i"), ("1", "l"), ("0", "o"), ("5", "s"), ("8", "s")],
    "fraktur": [("I", "J"), ("n", "u"), ("e", "c"), ("r", "x"), ("k", "t"), ("b", "h"), ("v", "o"), ("tz", "ß"), ("ch", "ck"), ("m", "in")],
    "kurrent": [("e", "n"), ("n", "u"), ("m", "n"), ("h", "b"), ("h", "f"), ("a", "o"), ("z", "y"), ("c", "e"), ("i", "e"), ("v", "r"), ("t", "k"), ("ll", "st"), ("w", "m")],
}
