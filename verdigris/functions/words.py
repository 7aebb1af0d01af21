"""Word lists of the normalizer, and number words built from short lists."""

# English contractions and what they stand for.
CONTRACTIONS = {
    "i'm": "i am",
    "i've": "i have",
    "i'll": "i will",
    "i'd": "i would",
    "you're": "you are",
    "you've": "you have",
    "you'll": "you will",
    "you'd": "you would",
    "he's": "he is",
    "he'll": "he will",
    "he'd": "he would",
    "she's": "she is",
    "she'll": "she will",
    "she'd": "she would",
    "it's": "it is",
    "it'll": "it will",
    "it'd": "it would",
    "we're": "we are",
    "we've": "we have",
    "we'll": "we will",
    "we'd": "we would",
    "they're": "they are",
    "they've": "they have",
    "they'll": "they will",
    "they'd": "they would",
    "that's": "that is",
    "that'll": "that will",
    "that'd": "that would",
    "who's": "who is",
    "who'll": "who will",
    "who'd": "who would",
    "what's": "what is",
    "what'll": "what will",
    "what'd": "what would",
    "where's": "where is",
    "where'll": "where will",
    "where'd": "where would",
    "when's": "when is",
    "when'll": "when will",
    "when'd": "when would",
    "why's": "why is",
    "why'll": "why will",
    "why'd": "why would",
    "how's": "how is",
    "how'll": "how will",
    "how'd": "how would",
    "there's": "there is",
    "there'll": "there will",
    "there'd": "there would",
    "here's": "here is",
    "isn't": "is not",
    "aren't": "are not",
    "wasn't": "was not",
    "weren't": "were not",
    "hasn't": "has not",
    "haven't": "have not",
    "hadn't": "had not",
    "doesn't": "does not",
    "don't": "do not",
    "didn't": "did not",
    "won't": "will not",
    "wouldn't": "would not",
    "shan't": "shall not",
    "shouldn't": "should not",
    "can't": "cannot",
    "couldn't": "could not",
    "mustn't": "must not",
    "mightn't": "might not",
    "needn't": "need not",
    "let's": "let us",
    "ain't": "is not",
    "o'clock": "of the clock",
    "ma'am": "madam",
}

# Filler words.
EN_FILLERS = ("uh", "uhm", "um", "umm", "er", "err", "ah", "ahh", "hm", "hmm", "huh", "mhm", "mm", "mmm")
DE_FILLERS = ("äh", "ähm", "öh", "öhm", "hm", "hmm", "mhm", "mm", "mmm")

# Number words from 1 to 19, and tens from 20 on.
EN_SMALL = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
EN_TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
DE_SMALL = ("ein", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "elf", "zwölf", "dreizehn", "vierzehn", "fünfzehn", "sechzehn", "siebzehn", "achtzehn", "neunzehn")
DE_TENS = ("zwanzig", "dreißig", "vierzig", "fünfzig", "sechzig", "siebzig", "achtzig", "neunzig")


def english_below_thousand() -> list[str]:
    """Words of 0 to 999 without "and" or hyphens; 0 is empty, since it only follows thousands."""
    tens = ["", *EN_SMALL] + [" ".join(filter(None, (t, u))) for t in EN_TENS for u in ("", *EN_SMALL[:9])]
    return [" ".join(filter(None, (f"{h} hundred" if h else "", t))) for h in ("", *EN_SMALL[:9]) for t in tens]


def german_below_thousand() -> list[str]:
    """Words of 0 to 999 in one piece, units before tens; 0 is empty and 1 is "ein" as in compounds."""
    tens = ["", *DE_SMALL] + [f"{u}und{t}" if u else t for t in DE_TENS for u in ("", *DE_SMALL[:9])]
    return [(f"{h}hundert" if h else "") + t for h in ("", *DE_SMALL[:9]) for t in tens]
