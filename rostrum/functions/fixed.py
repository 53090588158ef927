"""Fixed values.

Everything in this module is a constant that results depend on: word lists,
character maps, label sets and patterns. They are data, stated as plain text.
Lexicons that a user brings (stance words, gazetteers, vectors) are tables and
are passed to the operators as arguments.
"""

# Boilerplate strings, each replaced by one space, in this order.
BOILERPLATE = [
    "The American Presidency Project",
    "AboutSearch",
    "About Search",
    "Click to watch",
    "Return to Transcripts main page",
    "CNN LIVE EVENT/SPECIAL",
    "Transcribe Your Own Content Try Rev for free and save time transcribing & captioning.",
    "Transcribe or caption speeches, interviews, meetings, town halls, phone calls, and more.",
    "Rev is the largest, most trusted, fastest, and most accurate provider of transcription services and closed captioning & subtitling services in the world. Gov.",
    "This website stores cookies on your computer.",
    "These cookies are used to improve your website experience and provide more personalized services to you, both on this website and through other media.",
    "To find out more about the cookies we use, see our Privacy Policy.",
    "We won't track your information when you visit our site. But in order to comply with your preferences, we'll have to use just one tiny cookie so that you're not asked to make this choice again.",
    "[Laughter]", "[Applause]", "[Inaudible]", "(Laughter)", "(Applause)",
    "[President's biographer]", "[gesturing, as if climbing a ladder]",
    "[former House Speaker]", "[and other]", "[Solidarity leader]",
    "[Soviet Foreign Minister]", "[Prime Minister]", "[Egyptian President]",
    "[Israeli Prime Minister]", "[interviewed", "[interviewer",
    "[laughter]", "[applause]", "[inaudible]", "(laughter)", "(applause)", "(inaudible)",
    "[Referring to a tape recorder]", "[Secretary of Defense Weinberger]", "[Disaster]",
    "[voice-over]", "[voiceover]", "[set]*", "[Tax]", "[Yoo]", "[billion]", "[Boggs]",
    "[Aung San Suu Kyi] *", "[Helmut Kohl]", "[sigh]", "[chuckles]",
    "[Watching the world cup on AF1]", "[question about his family]",
    "[nuclear arms reduction]",
    "[signed with Russian President Dmitry Medvedev April 8, 2010]",
    "[Secretary of Health and Human Services-designate]",
    "[Secretary of the Treasury-designate]", "[Chief of Staff to the President]",
    "[of State-designate]",
    "[Chairman of the Board of Governors of the Federal Reserve System]",
]

# Characters mapped before every other non-ASCII character is dropped.
CHAR_MAP = [
    ("\u200b", " "), ("\u2013", "-"), ("\u2014", "-"), ("\u2019", "'"), ("\u2018", "'"),
    ("\n", " "), ('"', " "), ("\t", " "), ("\r", " "), ("\xa0", " "),
]

# English contractions, case-sensitive whole words.
CONTRACTIONS = {
    "I've": "I have", "i've": "i have",
    "Haven't": "Have not", "haven't": "have not",
    "Isn't": "Is not", "isn't": "is not",
    "We've": "We have", "we've": "we have",
    "Don't": "Do not", "don't": "do not",
    "Doesn't": "Does not", "doesn't": "does not",
    "Can't": "Can not", "can't": "can not",
    "Cannot": "Can not", "cannot": "can not",
    "Should've": "Should have",
    "Couldn't": "Could not", "couldn't": "could not",
    "Won't": "Will not", "won't": "will not",
    "Wouldn't": "Would not", "wouldn't": "would not",
    "Shouldn't": "Should not", "shouldn't": "should not",
    "Didn't": "Did not", "didn't": "did not",
    "Hasn't": "Has not", "hasn't": "has not",
    "Hadn't": "Had not", "hadn't": "had not",
    "Aren't": "Are not", "aren't": "are not",
    "Weren't": "Were not", "weren't": "were not",
    "It's": "It is", "it's": "it is",
    "That's": "That is", "that's": "that is",
    "Let's": "Let us", "let's": "let us",
    "You're": "You are", "you're": "you are",
    "They're": "They are", "they're": "they are",
    "We're": "We are", "we're": "we are",
    "Who's": "Who is", "who's": "who is",
    "What's": "What is", "what's": "what is",
    "Where's": "Where is", "where's": "where is",
    "When's": "When is", "when's": "when is",
    "Why's": "Why is", "why's": "why is",
    "How's": "How is", "how's": "how is",
    "She's": "She is", "she's": "she is",
    "He's": "He is", "he's": "he is",
    "It'll": "It will",
    "She'll": "She will", "she'll": "she will",
    "He'll": "He will", "he'll": "he will",
    "here's": "here is", "Here's": "Here is",
    "There's": "There is", "there's": "there is",
    "I'm": "I am", "i'm": "i am",
    "We'll": "We will", "we'll": "we will",
    "They'll": "They will", "they'll": "they will",
    "I'll": "I will", "i'll": "i will",
    "You'll": "You will", "you'll": "you will",
    "You've": "You have", "you've": "you have",
    "They've": "They have", "they've": "they have",
    "wasn't": "was not",
}

# Placeholder patterns, applied in this order.
EMOJI_RANGES = [
    (0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF),
    (0x1F1E0, 0x1F1FF), (0x2702, 0x27B0), (0x24C2, 0x1F251),
]
BARE_NUMBER = r"\b\d+\b"
YEAR_PERIOD = r"(?<!-)\b\d{2,4}'?s\b(?!-)"
NUMERIC_DATE = r"\b(0[1-9]|1[0-2])[-/](0[1-9]|[12][0-9]|3[01])[-/](\d{2}|\d{4})\b"
CLOCK_TIME = r"\b((1[0-2]|0?[1-9]):([0-5][0-9])(:[0-5][0-9])?(\s?[APap][Mm])?)\b"

# Entity labels.
NUMERIC_ENTITY_LABELS = ["PERCENT", "MONEY", "QUANTITY", "CARDINAL", "ORDINAL"]
CORE_ENTITY_LABELS = [
    "PERSON", "ORG", "NORP", "TIME", "DATE", "CARDINAL", "MONEY", "FAC",
    "QUANTITY", "PERCENT", "GPE",
]
ALL_ENTITY_LABELS = [
    "PERSON", "NORP", "FAC", "ORG", "GPE", "LOC", "PRODUCT", "EVENT", "WORK_OF_ART",
    "LAW", "LANGUAGE", "DATE", "TIME", "PERCENT", "MONEY", "QUANTITY", "ORDINAL",
    "CARDINAL",
]
PAIR_ENTITY_LABELS = [
    "PERSON", "NORP", "FAC", "ORG", "GPE", "LOC", "PRODUCT", "EVENT", "LAW", "DATE",
    "TIME", "MONEY", "QUANTITY",
]
EXTRA_ENTITIES = ["COVID-19", "COVID", "Army", "WeCanDoThis.HHS.gov", "HIV", "AIDS"]

# Second-level domains that are kept with the label before them.
SHARED_SECOND_LEVEL = ["com", "gov", "org", "net", "edu"]

# Word lists of the linguistic features.
PERSONAL_PRONOUNS = [
    "i", "me", "my", "mine", "you", "your", "yours", "he", "him", "his", "she", "her",
    "hers", "it", "its", "we", "us", "our", "ours", "they", "them", "their", "theirs",
]
NOMINAL_SUFFIXES = [
    "tion", "ment", "ness", "ity", "age", "ance", "ence", "hood", "ship", "ty", "cy",
    "al", "ure", "er", "ing", "sion", "ation", "ibility", "ana", "acy", "ama", "ant",
    "dom", "edge", "ee", "eer", "ery", "ese", "ess", "ette", "fest", "ful", "iac",
    "ian", "ie", "ion", "ism", "ist", "ite", "itude", "ium", "let", "ling", "man",
    "woman", "mania", "or", "th", "tude",
]
CLAUSE_DEPS = ["advcl", "relcl", "acl", "ccomp", "xcomp"]
LEXICAL_POS = ["NOUN", "VERB", "ADJ", "ADV"]
# One-word discourse markers only: a marker of several words never equals one token.
DISCOURSE_MARKERS = [
    "accordingly", "actually", "after", "afterward", "afterwards", "also", "although",
    "always", "anyway", "apparently", "as", "basically", "because", "before", "besides",
    "but", "chiefly", "clearly", "commonly", "consequently", "despite", "during",
    "either", "especially", "essentially", "eventually", "every", "evidently", "except",
    "exclusively", "finally", "first", "formerly", "forthwith", "fortunately",
    "frankly", "frequently", "further", "furthermore", "generally", "hence",
    "henceforth", "honestly", "however", "immediately", "incidentally", "including",
    "indeed", "individually", "initially", "instantly", "instead", "interestingly",
    "just", "largely", "last", "lastly", "lately", "later", "lest", "like", "likewise",
    "mainly", "markedly", "meanwhile", "merely", "moreover", "most", "mostly",
    "naturally", "neither", "never", "nevertheless", "next", "nonetheless", "nor",
    "normally", "notably", "notwithstanding", "now", "nowadays", "obviously",
    "occasionally", "often", "once", "only", "ordinarily", "originally", "otherwise",
    "overall", "particularly", "permanently", "personally", "plainly", "plus",
    "presently", "presumably", "previously", "primarily", "privately", "probably",
    "promptly", "properly", "publicly", "quickly", "rarely", "rather", "readily",
    "really", "recently", "regardless", "regularly", "relatively", "remarkably",
    "respectively", "secondly", "seemingly", "seldom", "separately", "seriously",
    "shortly", "significantly", "similarly", "simply", "since", "slightly", "slowly",
    "so", "sometimes", "soon", "specifically", "still", "straightaway", "strangely",
    "strongly", "subsequently", "successfully", "suddenly", "supposedly", "supposing",
    "surely", "surprisingly", "technically", "temporarily", "then", "thereafter",
    "thereby", "therefore", "thereupon", "thirdly", "though", "thus", "till",
    "typically", "ultimately", "undoubtedly", "unfortunately", "unless", "unlike",
    "until", "usually", "utterly", "virtually", "well", "whatever", "when", "whenever",
    "whereas", "whereby", "whereupon", "wherever", "whether", "whichever", "while",
    "whilst", "whoever", "yet",
]

# Pronouns of the person gates.
FIRST_PERSON = ["i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves"]
SECOND_PERSON = ["you", "your", "yours", "yourself", "yourselves"]
THIRD_PERSON = [
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its",
    "itself", "they", "them", "their", "theirs", "themselves",
]

# Dependency labels of the meaning and topic rules.
SUBJECT_DEPS = ["nsubj", "nsubjpass"]
ROOT_DEPS = ["ROOT"]
OBJECT_DEPS = ["dobj", "iobj", "pobj"]
TOPIC_DEPS = ["nsubj", "nsubjpass", "dobj", "pobj", "attr", "advcl"]

# Lexical continuity.
CONTENT_POS = ["NOUN", "PROPN", "VERB", "ADJ", "ADV", "NUM"]
SEMANTIC_POS = ["NOUN", "VERB", "ADJ", "ADV", "PROPN"]
REFERENTIAL_PRONOUNS = [
    "this", "these", "those",
    "i", "me", "my", "mine", "we", "us", "our", "ours", "you", "your", "yours", "he",
    "him", "his", "she", "her", "hers", "it", "its", "they", "them", "their", "theirs",
    "myself", "yourself", "himself", "herself", "itself", "ourselves", "yourselves",
    "themselves",
    "who", "whom", "whose", "which", "what",
    "anyone", "anything", "everybody", "everything", "someone", "something", "none",
    "nothing",
]
IGNORED_UNITS = ["be", "ROOT", "other"]

# Transition markers tested against the first token of the second sentence.
CONTINUE_MARKERS = [
    "and", "so", "nor", "also", "furthermore", "moreover", "besides", "additionally",
    "plus", "namely", "specifically", "firstly", "secondly", "thirdly", "subsequently",
    "finally", "later", "afterwards", "thereupon", "henceforth", "because", "therefore",
    "thus", "hence", "indeed", "actually", "certainly", "truly", "undoubtedly",
    "clearly", "obviously", "evidently", "naturally", "notably", "unquestionably",
    "assuredly", "inarguably", "decidedly", "emphatically", "unequivocally",
    "categorically", "irrefutably", "explicitly", "conclusively", "essentially",
    "rewording",
]
SHIFT_MARKERS = [
    "but", "or", "however", "nevertheless", "nonetheless", "conversely", "although",
    "though", "despite", "instead", "whereas", "while", "yet", "contrarily",
    "differently", "unlike", "contradictorily", "still", "admittedly", "regardless",
    "notwithstanding", "albeit", "rather", "surprisingly", "previously", "initially",
    "lastly", "eventually", "until", "meanwhile", "thereafter", "consequently",
    "elsewhere", "nearby", "opposite", "adjacent", "beyond", "alongside", "amid",
    "among", "between", "across", "around", "behind", "beneath", "beside", "within",
    "surrounding", "over", "throughout",
]

# Modal verbs by kind, and modal phrases on lemmas.
MODALS = {
    "predictive": ["will", "shall", "would"],
    "possibility": ["may", "might", "could", "can"],
    "necessity": ["must", "should"],
}
MODAL_PHRASES = {
    "predictive": ["go to"],
    "necessity": ["have to", "need to", "ought to"],
}

# Categories whose negation counts as the other one.
OPPOSITES = {
    "positive": "negative", "negative": "positive",
    "certainty": "doubt", "doubt": "certainty",
    "emphatic": "hedge", "hedge": "emphatic",
    "pro": "con", "con": "pro",
}
STANCE_POS = ["ADJ", "ADV", "VERB"]
DROPPED_PUNCT = ["!", ".", "?", ",", ";", ":", "-", "–", "—"]

# Nouns of the construction patterns.
PRO_NOUNS = ["commitment", "support", "help", "endorsement", "favor", "agreement", "effort"]
CON_NOUNS = ["concern", "opposition", "disagreement", "threat"]

# Limits.
MIN_DOCUMENT_TOKENS = 450
WINDOW_MIN_TOKENS = 400
WINDOW_MAX_TOKENS = 510
PAIR_MAX_TOKENS = 512
MAX_SENTENCE_TOKENS = 50
MAX_CLAUSES = 4
MIN_GATE_WORDS = 15
TOPIC_MAX_DISTANCE = 7
SIMILARITY_THRESHOLD = 0.75
MAX_CORRELATION = 0.8

# Pairs, source titles and source texts holding any of these are dropped.
IGNORED_IN_PAIR = [
    "JOHNSON:", "STEPHANOPOULOS:", "MS. JEAN-PIERRE:",
    "Specifically, the EMBRACE Act would:", "permalink", "Governor Ron DeSantis:",
    "Ron DeSantis:", "President Biden:", "Boris Johnson:", "Pedro Pierluisi:",
    "Nihad Awad:", "RADDATZ:", "President Donald Trump:", "CORRESPONDENT:",
    "Chicago Daily Herald:", "Rohit Chopra:", "Xavier Becerra:", "Judith Persichilli:",
    "Governor Andrew Cuomo:", "Q:", "Q.", "Governor Cuomo:", "Speaker 2:", "ESPER:",
    "THE PRESIDENT:", "Ambassador Spogli.",
]
IGNORED_IN_TITLE = [
    "press release", "statement", "readout", "announcement", "declaration", "letter",
    "proclamation", "Warren", "Executive Order", "Fact Sheet", "Klobuchar",
    "After Arrest Of Chinese", "Blumenthal", "This Week' Transcript",
    "Brown, Colleagues Urge Biden", "Schatz Introduces New Legislation",
    "Pelosi Transcript of Press", "Ahead of Medicare and Medicaid's", "SCHUMER",
    "Health IG Launches Inquiry", "Baldwin", "Schiff", "Warner", "Booker",
]
IGNORED_IN_TEXT = [
    "WASHINGTON -", "WASHINGTON –", "WASHINGTON —", "WASHINGTON-", "WASHINGTON–",
    "WASHINGTON—", "Washington, D.C. -", "Washington, D.C. –", "Washington, D.C. —",
    "WASHINGTON, D.C. -", "WASHINGTON, D.C. –", "WASHINGTON, D.C. —",
    "Washington, DC -", "Washington, DC –", "Washington, DC —", "Washington D.C. -",
    "Washington D.C. –", "Washington D.C. —", "Washington D.C.-", "Washington D.C.–",
    "Washington D.C.—", "Washington, DC-", "Washington, DC–", "Washington, DC—",
]
PAIR_BRACKETS = r"[{}\[\]()]"
PAIR_SEPARATOR = " [SEP] "
