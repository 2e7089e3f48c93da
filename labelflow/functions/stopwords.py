"""Stopword list used by phrase mining.

FIXED VALUES: the default Dutch stopword list of the mining step, in its
original order.  Results of mining depend on it, so it must stay exactly as
it is; pass another list to the mining functions for other languages.
"""

DUTCH_STOPWORDS: tuple[str, ...] = (
    "de", "het", "een", "en", "van", "in", "is", "dat", "op", "te",
    "zijn", "met", "voor", "niet", "aan", "er", "ook", "om", "naar",
    "of", "als", "maar", "die", "deze", "dit", "door", "uit", "bij",
    "dan", "wel", "nog", "zo", "ze", "hij", "haar", "zij", "hun", "u",
    "je", "jij", "we", "wij", "ons", "onze", "mijn", "jouw", "uw",
    "wat", "welke", "wie", "waarom", "hoe", "waar", "wanneer", "want",
    "tot", "tegen", "over", "onder", "boven", "achter", "binnen",
    "buiten", "tussen", "zonder", "behalve", "hierbij", "daarbij",
    "echter", "toch", "reeds", "al", "alle", "alles", "andere", "ander",
    "elk", "elke", "iedere", "veel", "weinig", "geen", "ja", "nee",
    "heeft", "heb", "hebben", "had", "hadden", "was", "waren",
    "wordt", "worden", "werd", "werden", "zal", "zullen", "zou", "zouden",
    "kan", "kunnen", "kon", "konden", "moet", "moeten", "moest", "moesten",
    "mag", "mogen", "mocht", "mochten", "wil", "willen", "wilde", "wilden",
)
