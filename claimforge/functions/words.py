"""Word lists, lookup tables and patterns that results depend on."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------

NEGATION_WORDS = (
    "not no never none nobody nothing nowhere neither nor cannot cant wont wouldnt "
    "shouldnt couldnt didnt doesnt isnt arent wasnt werent havent hasnt hadnt without"
).split()

HEDGE_WORDS = (
    "maybe perhaps possibly probably likely unlikely might may could seem seems seemed "
    "appears appear appeared suggests suggest indicates indicate approximately around "
    "about roughly generally sometimes often occasionally usually typically tend tends "
    "tended supposedly allegedly reportedly apparently presumably ostensibly"
).split()

ABSOLUTIST_WORDS = (
    "always never everyone everybody nobody everything nothing everywhere nowhere all "
    "none only absolute absolutely completely entirely totally perfectly impossible "
    "certain certainly guaranteed undeniably unquestionably definitively proven fact "
    "truth lie lied lies false hoax"
).split()

KEPT_NEGATIONS = ["no", "not", "nor", "never", "n't"]

SPEAKER_TITLES = "mr mrs ms dr gov sen rep pres prof".split()

JOB_TITLES = (
    "ceo cfo cto professor doctor dr senator judge mayor governor attorney lawyer "
    "president executive director"
).split()

MAJOR_PARTIES = ["democrat", "republican"]

INSTITUTIONAL_ROLES = (
    "state-official business-leader journalist newsmaker columnist county-commissioner "
    "education-official labor-leader activist"
).split()

TOP_PARTIES = ["republican", "democrat", "none", "organization", "independent"]

US_WORDS = ["us", "united states", "usa"]

NEGATION_FORMS = (
    "no not never none cannot can't won't don't doesn't didn't isn't aren't ain't"
).split()

# Contractions: form, expansion.
CONTRACTIONS = [
    ("can't", "can not"), ("won't", "will not"), ("don't", "do not"), ("doesn't", "does not"),
    ("didn't", "did not"), ("hasn't", "has not"), ("haven't", "have not"),
    ("wouldn't", "would not"), ("wasn't", "was not"), ("couldn't", "could not"),
    ("shouldn't", "should not"), ("aren't", "are not"), ("weren't", "were not"),
    ("i'm", "i am"), ("we're", "we are"), ("they're", "they are"), ("you're", "you are"),
    ("we've", "we have"), ("i've", "i have"), ("you've", "you have"), ("they've", "they have"),
    ("i'd", "i would"), ("who'd", "who would"), ("it's", "it is"), ("he's", "he is"),
    ("that's", "that is"), ("there's", "there is"), ("who's", "who is"), ("what's", "what is"),
    ("let's", "let us"),
]
BARE_CONTRACTIONS = [
    ("weve", "we have"), ("ive", "i have"), ("youve", "you have"), ("theyve", "they have"),
    ("dont", "do not"), ("doesnt", "does not"), ("didnt", "did not"), ("cant", "can not"),
    ("wont", "will not"), ("isnt", "is not"), ("arent", "are not"), ("wasnt", "was not"),
    ("werent", "were not"), ("hasnt", "has not"), ("havent", "have not"),
    ("wouldnt", "would not"), ("couldnt", "could not"), ("shouldnt", "should not"),
    ("hes", "he is"), ("shes", "she is"), ("thats", "that is"), ("theres", "there is"),
    ("whos", "who is"), ("whats", "what is"),
]
NAME_FIXES = [
    ("obamas", "obama"), ("bushs", "bush"), ("mccains", "mccain"), ("clintons", "clinton"),
]

# State: name, two-letter code, census region.
US_STATES = [
    ("alabama", "al", "south"), ("alaska", "ak", "west"), ("arizona", "az", "west"),
    ("arkansas", "ar", "south"), ("california", "ca", "west"), ("colorado", "co", "west"),
    ("connecticut", "ct", "northeast"), ("delaware", "de", "south"),
    ("district of columbia", "dc", "south"), ("florida", "fl", "south"),
    ("georgia", "ga", "south"), ("hawaii", "hi", "west"), ("idaho", "id", "west"),
    ("illinois", "il", "midwest"), ("indiana", "in", "midwest"), ("iowa", "ia", "midwest"),
    ("kansas", "ks", "midwest"), ("kentucky", "ky", "south"), ("louisiana", "la", "south"),
    ("maine", "me", "northeast"), ("maryland", "md", "south"),
    ("massachusetts", "ma", "northeast"), ("michigan", "mi", "midwest"),
    ("minnesota", "mn", "midwest"), ("mississippi", "ms", "south"),
    ("missouri", "mo", "midwest"), ("montana", "mt", "west"), ("nebraska", "ne", "midwest"),
    ("nevada", "nv", "west"), ("new hampshire", "nh", "northeast"),
    ("new jersey", "nj", "northeast"), ("new mexico", "nm", "west"),
    ("new york", "ny", "northeast"), ("north carolina", "nc", "south"),
    ("north dakota", "nd", "midwest"), ("ohio", "oh", "midwest"), ("oklahoma", "ok", "south"),
    ("oregon", "or", "west"), ("pennsylvania", "pa", "northeast"),
    ("rhode island", "ri", "northeast"), ("south carolina", "sc", "south"),
    ("south dakota", "sd", "midwest"), ("tennessee", "tn", "south"), ("texas", "tx", "south"),
    ("utah", "ut", "west"), ("vermont", "vt", "northeast"), ("virginia", "va", "south"),
    ("washington", "wa", "west"), ("west virginia", "wv", "south"),
    ("wisconsin", "wi", "midwest"), ("wyoming", "wy", "west"),
]

# Party alias: alias, canonical label; then ordered substring rules.
PARTY_ALIASES = [
    ("dem", "democrat"), ("democrat", "democrat"), ("democratic", "democrat"),
    ("republican", "republican"), ("rep", "republican"), ("gop", "republican"),
    ("ind", "independent"), ("independent", "independent"), ("libertarian", "libertarian"),
    ("lib", "libertarian"), ("green", "green"), ("tea party", "tea party"),
    ("unknown", "unknown"), ("none", "unknown"), ("na", "unknown"), ("n/a", "unknown"),
    ("other", "other"),
]
PARTY_SUBSTRINGS = [
    ("dem", "democrat"), ("rep", "republican"), ("gop", "republican"), ("ind", "independent"),
    ("libert", "libertarian"), ("green", "green"),
]

# Label word: word, class (1 = false claim).
LABEL_WORDS = [
    ("false", 1), ("fake", 1), ("mostly-false", 1), ("pants-fire", 1), ("true", 0),
    ("mostly-true", 0),
]

ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DENSITY_PUNCTUATION = ".,!?;:\"'-()[]{}"

# Occupation bucket: name, keywords; the first bucket with a hit wins.
OCCUPATIONS = [
    ("politics", "senator representative governor mayor".split()),
    ("law", "attorney judge lawyer prosecutor".split()),
    ("media", "journalist editor broadcaster".split()),
    ("business", "ceo cfo executive manager".split()),
    ("education", "professor teacher administrator".split()),
    ("healthcare", "doctor physician nurse".split()),
    ("public service", "official officer staff".split()),
]

# Unicode whitespace plus the four ASCII separators; only valid under the (?U) flag.
SPACE_CHARS = r"\s\x1C-\x1F"
WORD_CHARS = r"\p{L}\p{N}_"
# --- end of fixed values ----------------------------------------------------

SPACE = f"(?U:[{SPACE_CHARS}])"
#: The same characters one by one, for trimming.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_SPACE = f"(?U:[^{SPACE_CHARS}])"


def other_than(chars: str) -> str:
    """Class of everything but whitespace and ``chars``."""
    return f"(?U:[^{SPACE_CHARS}{chars}])"
