"""A small dictionary for the given tables' words, so that term matching has work to do; production dictionaries are arguments too."""

from itertools import product

from ..operators.classify import Gate, Topic, Topics

TOPICS = Topics(
    topics=(
        Topic("general", "General", ("the", "of the", "tion"), 5),
        Topic("romance", "Romance", ("de", "la", "que", "le", "en de"), 15),
        Topic("german", "German", ("der", "und", "die", "in der"), 20),
        Topic("licences", "Licences", ("apache license", "mit license", "cc by-nc", "4.0."), 30),
        Topic("gated", "Gated", ("that", "with", "on"), 10),
    ),
    priority_terms=("for the", "license", "été", "sich"),
    strong_gate=("license", "der", "est"),
    physics_gate=("to the", "den", "por"),
    ai_gate=("ai", "la", "on"),
    ai_methods=("by the", "un", "with"),
    gates={"gated": Gate(strong=("with",), context=("this", "by"), excluded=("!!",), core_sources=("src0",))},
    general="general",
    fallback="other",
    source_fallbacks=((("src3",), "romance"), (("src1",), "general")),
)

#: As many terms and categories as a production dictionary has: pairs of syllables, dealt to fifteen categories.
SYLLABLES = ("th", "on", "er", "ti", "he", "re", "an", "in", "es", "le", "en", "de", "la", "ou", "st", "or")
_PAIRS = [a + b for a, b in product(SYLLABLES, repeat=2)][:255]
_NAMES = ("general", "romance", *(f"topic{i:02d}" for i in range(13)))
LARGE_TOPICS = Topics(
    topics=tuple(Topic(name, name.title(), tuple(_PAIRS[i::15]), 4 + 2 * i) for i, name in enumerate(_NAMES)),
    priority_terms=("for the", "license", "été", "sich", "this"),
    general="general",
    fallback="other",
    source_fallbacks=((("src3",), "romance"), (("src1",), "general")),
)
