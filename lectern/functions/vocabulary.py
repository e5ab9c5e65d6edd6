"""Word lists of the rules, authored for this package; callers may pass their own."""

from __future__ import annotations

VAGUE = ("very", "quite", "rather", "somewhat", "really", "various", "several", "a lot of", "kind of", "in order to", "for", "that", "this", "with")
SIMPLER = {"utilize": "use", "in order to": "to", "prior to": "before", "a number of": "some", "from": "of", "which": "that", "have": "own"}
BE = ("am", "is", "are", "was", "were", "be", "been", "being", "get", "gets", "got")
# Function words by part of speech, each word under its first category.
POS = {
    "determiner": ("a", "an", "the", "this", "that", "these", "those", "every", "each"),
    "pronoun": ("it", "he", "she", "they", "we", "you", "i"),
    "conjunction": ("and", "or", "but", "nor", "so", "yet"),
    "preposition": ("of", "in", "to", "for", "with", "on", "at", "by", "from"),
    "auxiliary": ("is", "are", "was", "were", "be", "have", "has", "had", "will", "would", "can", "should"),
}
AN_BEFORE_CONSONANT = ("hour", "honest", "honor", "honour", "heir")
A_BEFORE_VOWEL = ("uni", "use", "usu", "util", "eu", "one", "once", "ewe", "uk")
#: Longer beginnings that go before those.
AN_LONGER = ("unin", "unim", "unidentif", "oneir")
#: Letters whose names begin with a vowel.
LETTERS_AN = "AEFHILMNORSX"
#: Words in -ed and -en that are no participles.
NO_PARTICIPLES = ("often", "even", "seven", "eleven", "ten", "then", "when", "open", "men", "women", "children", "garden", "need", "indeed", "speed", "feed", "seed", "red", "bed", "hundred")
IRREGULAR = (
    "begun", "bent", "bound", "bought", "brought", "built", "burnt", "caught", "cut", "dealt", "done", "drawn", "dug", "felt", "fed", "fought", "found", "flown", "frozen", "given", "gone", "grown", "had", "heard", "held", "hit", "hung", "hurt",
    "kept", "known", "laid", "led", "left", "lent", "let", "lit", "lost", "made", "meant", "met", "paid", "put", "quit", "read", "run", "said", "sent", "seen", "set", "shot", "shown", "shut", "sold", "sought", "spent", "split", "spread",
    "stood", "struck", "stuck", "sung", "swept", "sworn", "taught", "thought", "thrown", "told", "torn", "understood", "won", "worn", "wound", "written",
)
