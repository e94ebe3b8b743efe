"""Word lists, label sets and patterns of the rule classifiers. Fixed values throughout: results depend on them as they are."""

from __future__ import annotations

import re
from collections.abc import Sequence


def whole_words(words: Sequence[str]) -> str:
    """Pattern of any of the words as whole words."""
    return r"\b(?:" + "|".join(map(re.escape, words)) + r")\b"


# Genre labels.
NONFICTION_GENRES = (
    "Art", "History", "Biography & Memoir", "Business & Economics", "Cooking", "Health & Fitness", "Psychology", "Philosophy", "Politics",
    "Religion & Spirituality", "Self-Help", "Science & Nature", "True Crime", "Travel", "Music", "Education", "Reference",
)
FICTION_GENRES = (
    "Romance", "Fantasy", "Sci-Fi", "Mystery", "Thriller", "Horror", "Historical Fiction", "Literary Fiction", "General Fiction", "Adventure",
    "Erotica", "Western", "Humor", "Romantasy", "Paranormal", "Short Stories", "Graphic Novel",
)
CHILDRENS_GENRES = ("Children's", "Childrens", "Children")
POETRY_GENRES = ("Poetry", "Drama")

# Labels in lower case, for the second look at ambiguous books.
FICTION_LABELS = tuple(g.lower() for g in FICTION_GENRES) + (
    "young adult", "ya", "crime", "thriller & mystery", "thriller and mystery", "contemporary", "contemporary romance", "fantasy romance", "sci-fi romance",
    "historical", "small town", "dark romance", "paranormal romance", "urban fantasy", "dystopian", "romantasy", "romance", "chick lit",
    "new adult", "cozy mystery", "speculative fiction", "magical realism", "science fiction", "fiction",
)
NONFICTION_LABELS = tuple(g.lower() for g in NONFICTION_GENRES) + (
    "biography", "memoir", "nonfiction", "non-fiction", "science & nature", "social science", "computers", "technology", "medical", "law", "sports",
    "true crime", "essays", "journalism", "finance", "parenting", "crafts", "gardening", "language", "mathematics",
)
CHILDRENS_LABELS = ("children's", "childrens", "children", "juvenile", "picture book", "middle grade")
POETRY_LABELS = ("poetry", "drama", "plays")

# Subject headings that decide, and that only count together.
STRONG_FICTION = ("fiction", "juvenile fiction", "love stories", "science fiction", "fantasy fiction", "detective and mystery stories", "romans", "short stories", "novela", "roman")
STRONG_NONFICTION = (
    "nonfiction", "non-fiction", "handbooks", "manuals", "textbooks", "study and teaching", "biography", "autobiography", "guidebooks", "encyclopedias", "dictionaries",
    "criticism and interpretation", "case studies", "cookbooks", "programming", "computer", "algorithms", "medicine", "diets", "management", "statistics", "research",
    "history and criticism", "historiography", "themes, motives", "criticism", "bibliography",
)
WEAK_NONFICTION = (
    "history", "social conditions", "economic conditions", "politics and government", "psychology", "religion", "cooking", "travel", "science", "philosophy", "essays", "education",
    "health", "business", "art and society",
)

# Headings of the mystery shelf's second look.
MYSTERY_DECISIVE = ("biography", "autobiography", "autobiographies", "memoir", "criticism and interpretation", "history and criticism", "case studies", "study and teaching", "personal narratives", "historiography", "biographies")
MYSTERY_WEAK = ("handbooks", "manuals", "essays", "sources", "correspondence", "encyclopedias", "dictionaries", "true crime", "interviews", "anecdotes", "history", "politics and government", "social conditions")
MYSTERY_FICTION = ("fiction", "novel", "novels", "stories", "comic", "graphic novel", "romans", "fictional")
MYSTERY_FICTION_BLURB = r"\b(novel|novella|fictional|novelist)\b"

# Genre labels that count with a blurb's signals.
BLURB_FICTION_GENRES = (
    "romance", "Romantasy", "Mystery", "crime", "Thriller", "General Fiction", "romantic suspense", "Adventure", "Young Adult", "Fantasy", "Sci-Fi", "Science Fiction",
    "Horror", "Historical Fiction", "Literary Fiction",
)
BLURB_NONFICTION_GENRES = (
    "History", "Biography & Memoir", "Psychology", "Business & Economics", "Health & Fitness", "Politics", "Art", "Science & Nature", "Cooking", "Religion & Spirituality",
    "Philosophy", "Music", "Travel", "Self-Help",
)

# Keyword groups and the (genre, subgenre) that each stands for, in order.
GENRE_EVIDENCE = (
    (("erotica",), ("Romance", "erotica")),
    (("historical", "regency", "victorian", "1920s", "1950s", "wwii", "world war"), ("Romance", "historical romance")),
    (("paranormal", "vampire", "witch", "shifter", "werewolf", "ghost", "demon"), ("Romance", "paranormal romance")),
    (("fantasy", "magic", "fae", "dragon", "royalty fantasy"), ("Fantasy", "fantasy romance")),
    (("sci-fi", "science fiction", "space", "futuristic", "dystopian", "alien"), ("Sci-Fi", "sci-fi romance")),
    (("crime", "detective", "police", "murder", "thriller", "espionage", "assassin", "mystery", "fbi / cia", "law enforcement"), ("Mystery", "romantic suspense")),
    (("sports",), ("Romance", "sports romance")),
    (("christmas", "holiday"), ("Romance", "holiday romance")),
    (("small town", "small-town"), ("Romance", "small-town romance")),
    (("contemporary",), ("Romance", "contemporary romance")),
)
# Subgenres of books that are no romance.
PLAIN_SUBGENRE = {
    "sci-fi romance": None, "historical romance": "historical", "paranormal romance": "paranormal", "romantic suspense": "crime", "contemporary romance": "contemporary", "romantasy": None,
    "erotica": None, "sports romance": None, "holiday romance": None, "small-town romance": "small town",
}
# How a romance shows beside another genre.
ROMANCE_BLEND = {
    "Fantasy": "Romantasy", "Sci-Fi": "sci-fi romance", "Mystery": "romantic suspense", "Thriller": "romantic suspense", "Horror": "paranormal romance",
    "Historical": "historical romance", "Contemporary": "contemporary romance",
}
ROMANCE_TROPES = (
    "romantasy", "fated mates", "forbidden romance", "second chance romance", "second chance", "slow-burn romance", "slow burn romance", "dark romance",
    "friends to lovers", "enemies to lovers", "rivals to lovers", "grumpy-sunshine dynamic", "grumpy sunshine", "fake dating", "marriage of convenience", "forced marriage", "fake relationship",
)
ROMANCE_SUBGENRES = (
    "romantasy", "contemporary romance", "historical romance", "paranormal romance", "romantic suspense", "small-town romance", "sports romance", "holiday romance", "fantasy romance",
    "sci-fi romance", "erotica", "dark romance", "second chance romance",
)
SPICE_TAG_PARTS = ("spice", "heat", "euphemistic", "explicit", "closed door")
RECLASS_JUNK_PARTS = ("favourite", "favorite", "best of", "recommended", "review", "to buy", "tbr", "wish list", "wishlist", "all reviews", "books fiction", "kindle", "audiobook", "ebook")

# Categories of encyclopedia pages.
CATEGORY_FICTION = (
    r"\bnovels?\b|short story collections|\bnovellas?\b|fantasy|science fiction|children's (books|novels|literature)|young adult|picture books|"
    r"(?<!non-)(?<!non )\bfiction\b|\bplays\b|poetry|comics|graphic novels|fairy tales|mystery fiction|thriller|romance novels|horror fiction"
)
CATEGORY_NONFICTION = (
    r"non-?fiction|biograph|\bmemoirs?\b|autobiograph|history books|\bessays?\b|self-help|textbooks|reference works|cookbooks|travel books|popular science|"
    r"academic|guidebooks|\btreatises?\b|journalism"
)
INTRO_LANGUAGE = (
    r"is a[n]? (?:\d{4} )?(spanish|french|german|italian|portuguese|russian|japanese|chinese|dutch|swedish|norwegian|danish|polish|czech|greek|arabic|"
    r"turkish|hebrew|hindi|korean|finnish|hungarian|romanian|catalan)[- ](?:language )?(?:novel|book|work|memoir|play|poem)"
)
INTRO_NOVEL = r"is a[n]? (?:\d{4} |bestselling |debut )*(novel|thriller|mystery|fantasy|science fiction novel|children's|young adult|picture book|short story)"

# Leading determiners and letters that no English title has.
FOREIGN_ARTICLE = r"^\s*(la|le|les|el|los|las|il|gli|lo|une|una|uno|uns|unas|unos|uma|umas|der|die|das|den|dem|des|ein|eine|einen|einem|het|een|l'|d'|dell'|el|els)\b"
FOREIGN_LETTER = r"[ñ¿¡ßãõœ]"
NONLATIN_SCRIPTS = r"[Ѐ-ӿͰ-Ͽ֐-׿؀-ۿݐ-ݿऀ-ॿঀ-৿਀-ൿ฀-๿ᄀ-ᇿ가-힯぀-ヿ一-鿿㐀-䶿]"

# Phrases of descriptions that belong to no book.
JUNK_DESCRIPTION = ("large print", "see https", "drama critics", "presents ", "winter garden", "directed by", "an evening with", "book review of", "companion website", "about the significance")

# Raw terms that are no vocabulary: whole, in part, by pattern and by prefix.
BLOCKED_WHOLE = (
    "#digitally-own", "digitally-own", "paperback", "hardcover", "hardback", "ebook", "e-book", "kindle", "audiobook", "audio", "audible",
    "all reviews & lists", "all reviews and lists", "books fiction", "english", "fiction in english", "anthologies", "book", "books",
    "fiction", "nonfiction", "non-fiction", "general", "unknown", "none", "to-read", "currently-reading", "read", "tbr", "owned", "wishlist",
    "favorites", "favourites", "default", "shelf", "my-books", "library", "reviews", "lists", "series", "novel", "novels", "adult", "new",
)
BLOCKED_PARTS = (
    "digitally", "borrowed", "loaned", "purchased", "bought", "to-buy", "wish-list", "reviewed", "review-", "shelf-", "goodreads",
    "storygraph", "netgalley", "calibre", "did-not-finish", "reread", "re-read", "currently", "rating",
)
BLOCKED_PATTERNS = (r"^\d+\s*-?\s*stars?$", r"^stars?$", r"^dnf$", r"^arc$", r"^own$", r"^owns$", r"^owned\b.*", r"^\d{4}$", r"^\d{4}\s*-\s*\d{4}$")
BLOCKED_PREFIXES = ("#", "@", "http", "www.")

# A blurb's patterns: explicit fiction, narrative hints, expository markers.
BLURB_EXPLICIT = r"\bnovels?\b|\bnovella\b|\bnovelist\b|\bwork of fiction\b|\bpicture book\b|\bshort stor(y|ies)\b|\ba (fairy )?tale of\b|\bpicture[- ]book\b"
BLURB_HINTS = (
    r"\ba (thrilling|gripping|sweeping|heartwarming|haunting|charming|poignant) (tale|story|saga|debut|read)\b|\ba story of\b|\bfairy tale\b|"
    r"\bfantasy (adventure|world|epic)\b|\bwhen (a|an|the|her|his|young|she|he)\b.{0,40}\b(must|discovers?|finds?|meets?|falls?|realizes?|sets? (out|off)|"
    r"embarks?)\b|\bmust (save|find|stop|escape|choose|protect|fight|survive|uncover|defeat)\b|\b(magical|enchanted|mythical) (world|kingdom|land|realm)\b|"
    r"\bcoming[- ]of[- ]age (story|tale|novel)\b"
)
BLURB_EXPOSITORY = (
    r"\bthis (book|volume|study|biography|memoir|guide|history|work|collection) \b|\ba (history|biography|memoir|study|guide|celebration|portrait|survey|"
    r"chronicle) of\b|\bthe (history|biography|life|making|science) of\b|\btrue story\b|\breal[- ]life\b|\bnonfiction\b|\bnon-fiction\b|\bhow to\b|"
    r"\bguide to\b|\bhandbook\b|\bintroduction to\b|\bexamin(e|es|ing) (the|how|various)\b|\bexplores? (the|how|why)\b|\bargues that\b|"
    r"\bdraws? on\b|\bfully illustrated\b|\bphotographs?\b|\brecipes?\b|\bessays\b|\bchapters\b|\bscholar|\bacademic\b|\banthology\b|\bmemoir\b|"
    r"\baccount of\b|\bresearch\b|\btextbook\b|\bdigitized by\b|\bannotated\b|\btranslation\b|\bgeography of\b|\bbiograph|\bautobiograph|\breport(s)? (the|on|that)\b|"
    r"\banalyzes?\b|\binvestigat(es|ion)\b|\bnarrative history\b|\bself[- ]help\b|\bthe (definitive|inside|untold|secret|true) (history|story|account)\b"
)
# Words of categories of non-fiction.
CATEGORY_WORDS = ("biography", "history", "science", "self-help", "business", "cooking", "religion", "philosophy", "psychology", "travel", "health", "political", "true crime", "reference", "education", "social science", "nature", "art", "music")
