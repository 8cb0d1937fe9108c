"""Word lists and maps of the text analysis.  Fixed values: results depend on every entry."""

from __future__ import annotations

# Words that carry no content.
STOP = """
a about again am an and any are at be can cant could did do does dont g get getting go going got guess
had has have he her here hers him his how i id ill im in is it its ive knew know me mine my no of on or
our ours please really recall remember s she should some still tell that the their them there these they
think this those to u us want wanted was we were what whats who will wont would yes you your
""".split()

# Words that are never a value and don't count against a fact's specificity.
STOP_VALUES = """
actually after also always anything anyway around as aunt back basically be because been before being bit
boss brother but by bye cat color colour cool cousin dad daughter day days definitely dog down drive drives
even everything father favorite favourite fine food for friend from get gets goes going gonna good got gotta
grandma grandpa great had has have having hello here heres hey hi hmm honestly hows husband if into just
kinda lets like liked likes literally live lived lives lol long lot maybe mom mostly mother nah name named
names never new nice no not nothing now off oh okay onto oops out over probably really right sister so
something sometimes son sorta still suppose supposed sure than thank thanks then there theres thing things through
time times today tomorrow tonight too uncle under up use used using very wanna want wanted wants week well went while wife
with wow ya yeah yep yes yesterday
""".split()

# Relations between people, pets and vehicles.
RELATIONS = """
aunt bike bird brother car cat cats cousin dad daughter dog dogs father fish grandma grandpa hamster husband
kitten kittens mom mother pet puppies puppy sister son truck uncle wife
""".split()

# Words for numbers.
NUMBERS = """
one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
eighteen nineteen twenty thirty forty fifty hundred thousand million dozen
""".split()

# Fillers that a fact's head skips.
FILLERS = """
actually also and anyway basically but hey hmm honestly just listen literally look nah no oh ok okay oops so
sorry still then uh um wait well wow yeah yep yes
""".split()

# Irregular forms by their base.
_IRREGULAR = {
    "age": "aged old", "buy": "bought", "city": "hometown town", "color": "colour", "drink": "drank", "drive": "drove",
    "eat": "ate", "favorite": "favourite", "feel": "felt", "give": "gave", "go": "goes went",
    "job": "career employed occupation profession work working", "kid": "children kids", "make": "made", "meet": "met",
    "run": "ran", "say": "said", "see": "saw", "sleep": "slept", "take": "took", "tell": "told", "today": "day days",
    "write": "wrote",
}
# Synonyms by the word that stands for them.
_SYNONYMS = {
    "city": "based home hometown live lives living located location reside resides", "deadline": "due",
    "depends": "blocker dependency needs requires", "editor": "ide", "email": "mail", "handle": "user username",
    "job": "occupation position profession role title", "manager": "boss lead manage manages report reporting reports supervisor",
    "owner": "own owned owns", "phone": "cell mobile", "plan": "membership subscription tier", "timezone": "tz zone",
}
IRREGULAR = {w: base for base, words in _IRREGULAR.items() for w in words.split()}
SYNONYMS = {w: base for base, words in _SYNONYMS.items() for w in words.split()}

# Animals kept at home.
PETS = "bird cat dog fish hamster kitten pet puppy".split()

# Suffixes in the order in which a root loses one.
SUFFIXES = "ization ation ments ment ness ing ion ies es ed er s".split()

# Words that negate, after apostrophes are gone.
NEGATORS = "not never cannot cant wont isnt arent wasnt werent dont doesnt didnt no".split()

# Words without distributional signal.
SEMANTIC_STOP = """
the a an and or of to in on at is are was were be been it its this that these those as by for with from but
not no so if then than too very can will would could should i you he she we they him her his them my your our
their me us do did does have has had there here what which who when where how all any some such only own same
out up down off over under into upon
""".split()

# Characters trimmed from a token's ends, for matching and for showing.
TRIM_MATCH = "?.!,;:'\"\u2019><)([]}{"
TRIM_SHOW = "?.!,;:'\"()[]{}"


def stem_word(w: str) -> str:
    """The stem of one lexicon word (all are plain ASCII)."""
    w = IRREGULAR.get(w, w)
    if len(w) >= 5 and w.endswith("ies"):
        w = w[:-3] + "y"
    elif len(w) >= 4 and w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    return w[:6] if len(w) >= 8 else w[:5] if len(w) >= 5 else w


RELATION_STEMS = sorted({stem_word(w) for w in RELATIONS})
PET_STEMS = sorted({stem_word(w) for w in PETS})
STOP_VALUE_STEMS = sorted({stem_word(w) for w in STOP_VALUES})
