"""The words and patterns that the built-in checks look for."""

LEAD_INS = ["In today's", "It is important to note", "When it comes to", "At the end of the day", "In conclusion"]
CRUTCH_WORDS = "actually really very basically essentially literally simply clearly obviously".split()
CONTRACTIONS = [
    ("that is", "that's"), ("it is", "it's"), ("there is", "there's"), ("who is", "who's"), ("what is", "what's"),
    ("do not", "don't"), ("does not", "doesn't"), ("did not", "didn't"), ("cannot", "can't"), ("can not", "can't"),
    ("will not", "won't"), ("would not", "wouldn't"), ("should not", "shouldn't"), ("could not", "couldn't"),
    ("is not", "isn't"), ("are not", "aren't"), ("was not", "wasn't"), ("were not", "weren't"), ("have not", "haven't"),
    ("has not", "hasn't"), ("had not", "hadn't"), ("they are", "they're"), ("we are", "we're"), ("you are", "you're"),
    ("i am", "I'm"), ("let us", "let's"),
]
CERTAIN = r"\b(?:everyone knows|undeniably|proven)\b"
CLEARLY = r"\bclearly\s+(?:shows|demonstrates|proves|will|is)\b"
ALWAYS = r"\b(?:always|never)\b"
ALWAYS_HYPHEN = r"\b(?:always|never)-\w+"
NEVER_MODAL = r"\bnever\s+(?:had|would|could|should|might|may|will|can)\b"
NEVER_FIRST = r"^Never\s+\w"
CITED = r"https?://|\[[0-9]+\]|according to|\([12][0-9]{3}\)|\b20[0-9]{2}\b"
ENUMERATED = r"\bFirst,\s+.+\bSecond,\s+.+\bThird,\s+"
VAGUE = r"\b(?:very|significantly|dramatically|truly|really)\b.+\b(?:transform|revolutionize|leverage)\b"
PARTICIPLES = (
    "made done given taken held kept put set sent shown known seen written built found paid told brought bought caught "
    "taught thought lost begun chosen driven eaten forgotten gotten hidden broken spoken stolen worn torn drawn grown thrown "
    "sold shut led fed laid said heard meant understood struck hung won spent bound"
).split()
PASSIVE = rf"\b(?:is|are|was|were|be|been|being)\s+(?:\w+ed|{'|'.join(PARTICIPLES)})\b"
PERCENT = r"\d+(?:\.\d+)?%"
MULTIPLIER = r"\d+\s*[×x]\b|\d+\s+times\b"
COUNTED = r"\b\d{3,}\s+(?:users|ms|seconds|minutes|hours|days|requests|tokens)\b"
STICKER = r"#\d+\b"
TOKEN = r"[A-Za-z0-9']+"
WORD = r"[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*"
FUNCTION_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "can could did do does doing down during each few for from further had has have having he her here hers herself him "
    "himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other "
    "our ours ourselves out over own same she should so some such than that the their theirs them themselves then there "
    "these they this those through to too under until up very was we were what when where which while who whom why will "
    "with would you your yours yourself yourselves"
).split()
IMPERATIVES = (
    "add adjust align allow apply arrange ask assemble attach avoid back be bend block break bring build calculate call "
    "cancel change charge check choose clean clear click close collect compare complete confirm connect contact continue "
    "copy cover create cut decrease delete describe detach disconnect discard do download drain drill drive enable enter "
    "examine fill find fit fix flush follow fold give go grip hold identify inflate insert inspect install keep label leave "
    "lift limit lock loosen lower lubricate make mark measure meet monitor mount move note open order paint pay place plug "
    "point position pour prepare press prevent print protect pull push put raise read record reduce refer register release "
    "remove repair repeat replace report request reset restart return review rinse rotate run save scroll seal select send "
    "set shake shut sign slide speak specify start stop store submit supply switch take tap tell test tighten turn twist "
    "type unlock unplug update upload use verify visit wait wash wear wipe write"
).split()
SUBJECTS = "you we i the a an it they he she there this that these those user users operator operators person people".split()
DETERMINERS = "a an the this that each every any no another its their your our his her".split()
VERB_MARKERS = "will would can could must should shall may might do does did not please".split()
NEGATOR = r"(?:not|never|no|\w+n['’]t)"
NEGATIVE = (
    r"(?:nothing|nobody|none|nowhere|neither|never|no\s+one|"
    r"un(?:common|usual|likely|important|reasonable|known|clear|certain|aware|able|fair|helpful|necessary|"
    r"available|willing|wise|true|related|limited|acceptable|interesting|familiar|safe|lawful)|"
    r"in(?:frequent|significant|valid|correct|consistent|appropriate|accurate|complete|sufficient|capable)|"
    r"im(?:possible|probable|proper|material)|il(?:legal|logical)|ir(?:relevant|regular|responsible)|non\w{3,})"
)
DOUBLE_NEGATIVE = rf"\b{NEGATOR}\b(?:\s+\w+){{0,2}}?\s+{NEGATIVE}\b"
ACRONYM = r"\b[A-Z][A-Z0-9]*[A-Z](?:s)?\b"
KNOWN_ACRONYMS = "OK US USA UK EU UN AM PM TV ID PDF URL FAQ CEO DC II III IV VI VII VIII IX XI XII".split()
ING = r"\b[A-Za-z]{2,}ing\b"
ING_NOUNS = (
    "anything bring ceiling cling during evening everything fling king morning nothing ping pudding ring sing sling "
    "something spring sting string swing thing things wedding wing"
).split()
VOWELS = r"[aeiouy]+"
CONTRAST = r",\s*not\s+\w+"
SPLIT_STEPS = r"\b(?:and\s+then|and|then|or)\b|;"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]"
