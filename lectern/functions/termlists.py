"""Term lists of the list search, written for this package: a term, or a term with suggestions; callers may pass their own."""

from __future__ import annotations

AVOID = {
    "vague": ["very", "quite", "rather", "somewhat", "a lot of", "kind of", "sort of", "several", "various", "a couple of", "more or less", "and so on", "things", "stuff", "fairly", "pretty much"],
    "sidetrack": ["by the way", "incidentally", "as an aside", "it is worth noting", "needless to say", "as already mentioned", "speaking of which", "for what it is worth"],
    "qualifier": ["basically", "actually", "really", "simply", "literally", "essentially", "virtually", "practically", "honestly", "arguably"],
    "difficulty": ["easy", "easily", "obviously", "of course", "trivial", "straightforward", "just", "clearly", "hard", "difficult", "painless"],
    "anthropomorphism": ["thinks that", "wants to", "tries to", "knows how", "is happy to", "likes to", "decides to", "complains", "believes", "refuses to"],
    "voice": ["let us", "we will", "you will see", "as we saw", "I think", "in our opinion"],
    "modal": ["should be able to", "might want to", "may wish to", "could possibly"],
    "uncertainty": ["perhaps", "maybe", "probably", "presumably", "it seems", "apparently", "likely", "roughly", "hopefully", "in theory"],
    "expletive": ["there is a", "there are many", "it is important"],
    "tone": ["awesome", "cool", "nice", "ugly", "stupid", "crazy", "insane", "magic", "evil", "annoying"],
    "reference": ["see above", "see below", "the former", "the latter", "as shown here", "click here", "this page"],
    "promotional": ["powerful", "state of the art", "world class", "cutting edge", "best in class", "revolutionary", "seamless", "next generation", "blazing fast"],
}
DEV = {
    "development": ["work in progress", "to do", "not yet implemented", "coming soon", "in the next release", "currently not supported", "known bug", "deprecated soon", "will be fixed", "for now"],
    "jargon": ["boilerplate", "under the hood", "out of the box", "sanity check", "edge case", "corner case", "garbage in", "race condition", "spaghetti code", "monkey patch", "yak shaving", "dog food"],
}
SIMPLIFY = [
    ["utilize", "use"], ["in order to", "to"], ["prior to", "before"], ["subsequent to", "after"], ["a number of", "some"], ["in the event that", "if"], ["due to the fact that", "because"], ["at this point in time", "now"],
    ["facilitate", ["help", "ease"]], ["commence", ["begin", "start"]], ["terminate", ["end", "stop"]], ["endeavour", "try"], ["ascertain", "find out"], ["sufficient", "enough"], ["approximately", "about"], ["in close proximity to", "near"],
    ["has the ability to", "can"], ["make use of", "use"], ["with regard to", "about"], ["for the purpose of", "for"], ["is required to", "must"], ["the majority of", "most"], ["in spite of the fact that", "although"], ["additional", "more"],
]
