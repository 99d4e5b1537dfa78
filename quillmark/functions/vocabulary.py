"""Vocabularies of the matching and tagging kernels; callers may pass their own."""

from __future__ import annotations

# A formal given name and its short forms, in order of precedence.
NICKNAME_LINES = """
robert: bob rob bobby bert
william: bill will billy willy liam
richard: rick dick rich ricky
james: jim jimmy jamie
timothy: tim timmy
thomas: tom tommy
michael: mike mick mickey
joseph: joe joey
christopher: chris kit
anthony: tony ant
steven: steve stevie
stephen: steve stevie
edward: ed eddie ted teddy
charles: charlie chuck chas
daniel: dan danny
matthew: matt matty
andrew: andy drew
david: dave davey
kenneth: ken kenny
ronald: ron ronny ronnie
donald: don donny donnie
raymond: ray
lawrence: larry lars
nicholas: nick nicky
benjamin: ben benny benji
samuel: sam sammy
gregory: greg gregg
patrick: pat paddy
alexander: alex al xander
albert: al bert bertie
frederick: fred freddy freddie
gerald: jerry gerry
harold: harry hal
jeffrey: jeff geoff
jonathan: jon john jonny
peter: pete
phillip: phil
philip: phil
stanley: stan
theodore: ted teddy theo
walter: walt wally
elizabeth: liz lizzy beth betty eliza
margaret: maggie meg peggy marge
catherine: cathy kate katie cat
katherine: kathy kate katie kat
patricia: pat patty trish
jennifer: jen jenny
jessica: jess jessie
susan: sue susie suzy
rebecca: becky becca
barbara: barb barbie babs
dorothy: dot dotty dottie
deborah: deb debbie
nancy: nan
carolyn: carol carrie
christine: chris christy tina
virginia: ginny ginger
jacqueline: jackie jacqui
millard: mickey
"""
NICKNAMES: dict[str, list[str]] = {k: v.split() for k, v in (line.split(": ") for line in NICKNAME_LINES.strip().splitlines())}

# Words that mark an owner as an institution.
INSTITUTIONAL = "LLC INC CORP FUND CAPITAL MANAGEMENT GROUP TRUST PARTNER ADVISORS ADVISORY HOLDINGS INVESTMENT BANK INSURANCE LP L.P. ASSET ASSOCIATES VENTURES FINANCIAL SECURITIES MUTUAL COMPANY CO. LTD FOUNDATION EQUITY WEALTH".split()

# Phrases of a profile title that speak of a board.
BOARD_PHRASES = [
    "board member", "board of directors", "board director", "independent director", "non-executive director", "outside director",
    "board", "director", "trustee", "advisory board", "advisory council", "governance", "chairman", "chairwoman", "chairperson",
    "vice chair", "lead director", "presiding director",
]

# Topic words; a word with blanks around it counts only between blanks.
AI_TERMS = [
    "artificial intelligence", " ai ", "machine learning", " ml ", "deep learning", "neural network", "llm", "large language model", "generative ai", "gen ai",
    "chatgpt", "gpt", "claude", "gemini", "copilot", "automation", "algorithm", "data science", "predictive analytics", "nlp",
    "natural language processing", "computer vision", "robotics", "autonomous",
]
COVID_TERMS = [
    "covid", "covid-19", "covid19", "coronavirus", "pandemic", "epidemic", "lockdown", "quarantine", "social distancing", "remote work", "work from home",
    "wfh", "vaccine", "vaccination", "pfizer", "moderna", "omicron", "delta variant", "ppe", "mask mandate", "ventilator", "flatten the curve",
    "shelter in place", "essential worker", "frontline worker",
]
COVID_TERMS_WIDE = [
    "covid", "covid-19", "covid19", "coronavirus", "pandemic", "epidemic", "lockdown", "quarantine", "social distancing", "remote work", "work from home",
    "wfh", "vaccine", "vaccination", "pfizer", "moderna", "omicron", "delta variant", "ppe", "mask", "ventilator", "flatten the curve",
    "shelter in place", "essential worker", "frontline", "virtual meeting", "zoom fatigue",
]

# Degrees and titles taken out of names, per variant of the cleaner.
CREDENTIALS = {
    "generic": [r"\bPh\.?D\.?\b", r"\bM\.?D\.?\b", r"\bMBA\b", r"\bM\.?B\.?A\.?\b", r"\bCPA\b", r"\bC\.?P\.?A\.?\b", r"\bC\.?F\.?A\.?\b", r"\bCFA\b", r"\bJ\.?D\.?\b", r"\bEsq\.?\b", r"\bP\.?E\.?\b", r"\bDr\.?\b", r"\bKBE\b", r"\bAC\b", r"\bOBE\b", r"\bCBE\b", r"\bC\s+F\s+A\b", r"\bM\s+B\s+A\b", r"\bC\s+P\s+A\b"],
    "pilot": [r"\bPhD\.?\b", r"\bPh\.D\.?\b", r"\bMD\b", r"\bM\.D\.?\b", r"\bMBA\b", r"\bM\.B\.A\.?\b", r"\bCPA\b", r"\bC\.P\.A\.?\b", r"\bCFA\b", r"\bJD\b", r"\bJ\.D\.?\b", r"\bEsq\.?\b", r"\bPE\b", r"\bP\.E\.?\b", r"\bDr\.?\b"],
    "full": [r"\bPhD\.?\b", r"\bPh\.D\.?\b", r"\bMD\b", r"\bM\.D\.?\b", r"\bMBA\b", r"\bM\.B\.A\.?\b", r"\bCPA\b", r"\bC\.P\.A\.?\b", r"\bCFA\b", r"\bJD\b", r"\bJ\.D\.?\b", r"\bEsq\.?\b", r"\bPE\b", r"\bP\.E\.?\b", r"\bDr\.?\b", r"\bB\.?Sci?\.?\b", r"\bB\.?S\.?\b", r"\bM\.?S\.?\b", r"\bFAICD\b", r"\bRet\.?\b", r"\bUSMC\b", r"\bUSAF\b"],
    "parts": [r"\b(Ph\.?D\.?|M\.?D\.?|MBA|CPA|J\.?D\.?|Esq\.?)\b"],
}
GENERATIONS = r"\b(Jr\.?|Sr\.?|I{1,3}|IV|V|VI|VII|VIII|2nd|3rd|4th)\b"
GENERATION_WORDS = "jr sr ii iii iv v vi vii viii 2nd 3rd 4th".split()
# Endings of firm names, taken off in this order, once each.
FIRM_ENDINGS = [r"\s*,?\s*Inc\.?\s*$", r"\s*,?\s*Corp\.?\s*$", r"\s*,?\s*Corporation\s*$", r"\s*,?\s*Ltd\.?\s*$", r"\s*,?\s*LLC\s*$", r"\s*,?\s*L\.L\.C\.?\s*$", r"\s*,?\s*PLC\s*$", r"\s*,?\s*Co\.?\s*$", r"\s*,?\s*Company\s*$"]
FIRM_ENDINGS_WIDE = [*FIRM_ENDINGS, r"\s*,?\s*limited\s*$", r"\s*,?\s*group\s*$"]
NOISE_WORDS = "the a an and or of in at by for on".split()

#: A compact lexicon with categories as in a word-list dictionary (column > 0 means member).
LEXICON = {
    "positive": "achieve benefit best better good great grateful honest improve progress proud strong success support supports thanks worth understood improved reward polite curious".split(),
    "negative": "bad cannot criticised decline deficit delay difficult fail fell ignore loss late lose postponed question risk weak worse underestimated problem".split(),
    "uncertainty": "almost approximate could depend doubt forecast may maybe outlook perhaps pilot possible proposal risk test testing uncertain might rethinking".split(),
    "litigious": "audit board claim code committee compliance conduct contract court law legal policy regulator rules shall".split(),
    "constraining": "bound budget cannot commit compel delay freeze limit limited must obligation postponed require restrict tight without".split(),
}
