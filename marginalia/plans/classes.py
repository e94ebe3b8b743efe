"""Queries of the rule classifiers and text rules, case by case."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import rules, text
from marginalia.functions.similarity import partial_ratio
from marginalia.operators import classify, genres
from marginalia.operators.lexical import clean_description, match_context
from marginalia.operators.resolve import is_blocked
from marginalia.plans.cases import case_query

SIGNALS = classify.BlurbSignals(rules.BLURB_EXPLICIT, rules.BLURB_HINTS, rules.BLURB_EXPOSITORY)
C = F.col


@case_query(
    "book_class", "genres array<string>",
    [(["Children's", "Fantasy"],), (["Poetry"],), (["Poetry", "Romance"],), (["History"],), (["Romance", "Sci-Fi"],), (["History", "Literary Fiction"],), (["romance"],), ([],), (None,), (["Young Adult"],)],
    "book_class", [("childrens",), ("poetry_drama",), ("fiction",), ("nonfiction",), ("fiction",), ("ambiguous",), ("ambiguous",), ("ambiguous",), ("ambiguous",), ("ambiguous",)],
)
def book_class(df):
    return df.select("id", classify.book_class(C("genres")).alias("book_class"))


_BLURBS = [
    ("Ashes", "A novel of two sisters.", []),  # explicit, nothing against
    ("Grain", "This book argues that bread changed trade.", []),  # two expository, nothing for
    ("Salt", "A novel. Draws on the history of salt.", ["Mystery"]),  # 2 + genre against 2: lead 1
    ("Reef", "When a diver finds a wreck, she must escape.", ["Fantasy"]),  # two hints and a genre
    ("Tide", "A guide to knots.", ["History"]),  # two expository
    ("Dust", "", ["History"]),  # one point of genre
    ("Moss", None, []),
    ("Fern", "A gripping tale. Essays and research.", []),  # hint 1 against 2
]


@case_query("blurb_class", "title string, blurb string, genres array<string>", _BLURBS, "book_class", [("fiction",), ("nonfiction",), (None,), ("fiction",), ("nonfiction",), (None,), (None,), (None,)])
def blurb_class(df):
    return df.select("id", classify.blurb_class(C("title"), C("blurb"), C("genres"), SIGNALS).alias("book_class"))


@case_query("blurb_call", "title string, blurb string, genres array<string>", _BLURBS, "call", [("fiction",), ("nonfiction",), ("fiction",), ("fiction",), ("nonfiction",), ("uncertain",), ("uncertain",), ("nonfiction",)])
def blurb_call(df):
    return df.select("id", classify.blurb_call(C("title"), C("blurb"), C("genres"), SIGNALS).alias("call"))


@case_query(
    "label_class", "genres array<string>", [([" Juvenile "],), (["PLAYS"],), (["plays", "Chick Lit"],), (["Urban Fantasy"],), (["Finance", "law"],), (["law", "Romance"],), (["nothing known"],), (None,)],
    "book_class", [("childrens",), ("poetry_drama",), ("fiction",), ("fiction",), ("nonfiction",), (None,), (None,), (None,)],
)
def label_class(df):
    return df.select("id", classify.label_class(C("genres")).alias("book_class"))


@case_query(
    "subject_class", "subjects array<string>, scoped int",
    [(["Juvenile fiction"], 0), (["Nonfiction"], 0), (["Fiction", "Fiction -- History and criticism"], 0), (["Trade", "Economics"], 2), (["History of art", "Travel in Spain"], 0), (["Romance"], 0), (["Ocean travel"], 0), (None, 0)],
    "book_class", [("fiction",), ("nonfiction",), (None,), ("nonfiction",), ("nonfiction",), (None,), (None,), (None,)],
)
def subject_class(df):
    return df.select("id", classify.subject_class(C("subjects"), C("scoped")).alias("book_class"))


@case_query(
    "mystery_call", "subjects array<string>, blurb string",
    [(["Crime -- Biography"], "A life."), (["Biography", "Fiction"], "A life."), (["Biography"], "A novel."), (["Essays", "Interviews"], "Talks."), (["Essays"], ""), (["Essays"], "Talks."), (["Crime"], None), ([], "x")],
    "call", [("flip",), ("keep",), ("keep",), ("review",), ("review",), ("keep",), ("keep",), ("no_subjects",)],
)
def mystery_call(df):
    return df.select("id", classify.mystery_call(C("subjects"), C("blurb")).alias("call"))


@case_query(
    "page_class", "categories array<string>, intro string",
    [(["1990 novels"], ""), (["Non-fiction books"], ""), (["2001 novels", "American memoirs"], "X is a novel by Y"), ([], "X is a 1990 novel by Y"), ([], "X is a 1999 French novel by Y"), (["Books"], "X is a study"), (None, None), (["British fiction"], "It is a German-language memoir")],
    "book_class, language", [("fiction", None), ("nonfiction", None), (None, None), ("fiction", None), (None, "french"), (None, None), (None, None), ("fiction", "german")],
)
def page_class(df):
    return df.select("id", classify.page_class(C("categories"), C("intro")).alias("p")).select("id", "p.*")


@case_query("category_class", "categories array<string>", [(["juvenile fiction"],), (["history"],), (["history", "science fiction"],), (["juvenile nonfiction"],), (["games"],), ([],), (None,)], "book_class", [("fiction",), ("nonfiction",), ("fiction",), ("fiction",), (None,), (None,), (None,)])
def category_class(df):
    return df.select("id", classify.category_class(C("categories"), rules.CATEGORY_WORDS).alias("book_class"))


_TITLES = [
    ("Война и мир", "ru", 0.9999, 0.0), ("Dune", "de", 0.9999, 0.0), ("The old house", "en", 0.7, 0.7), ("Der alte Turm", "de", 0.9999, 0.001), ("Casa vieja grande", "es", 0.9999, 0.0),
    ("Le petit jardin", "fr", 0.8, 0.1), ("Karma cola extra", "it", 0.6, 0.3), ("Alte Häuser weiß", "de", 0.99996, 0.0), (None, "en", 0.5, 0.5), ("Some words here", None, None, None),
]


@case_query(
    "title_decision", "title string, guess string, share double, english double", _TITLES, "lang, english, basis, decision",
    [("nonlatin", False, "script", "archive"), ("?", None, "title-short", "keep"), ("en", True, "title", "keep"), ("de", False, "title", "archive"), ("es", False, "title", "uncertain"),
     ("fr", None, "title-lowconf", "uncertain"), ("it", None, "title-lowconf", "keep"), ("de", False, "title", "archive"), ("?", None, "title-short", "keep"), ("?", None, "detect-failed", "keep")],
)
def title_decision(df):
    language = classify.title_language(C("title"), C("guess"), C("share"), C("english"))
    return df.select("id", language.alias("l"), classify.title_decision(C("title"), language).alias("decision")).select("id", "l.lang", "l.english", "l.basis", "decision")


@case_query(
    "enrichment_doubt", "known boolean, confidence string, note string, blurb string, proposed array<string>, author string, year int",
    [(True, "high", "", "A plot.", [], "A", 1990), (False, "medium", "From knowledge", "", ["x", "y"], "A, B, C", 3000), (None, "low", "wrong match, from knowledge", "Directed by X", None, None, None), (True, "high", None, None, [], "A, B", 900)],
    "score, reasons",
    [(0, ""), (2 + 1 + 2 + 1 + 1 + 1 + 1, "known=false|medium confidence|from memory, not description|no description|proposed new term: x, y|author field polluted|suspect year 3000"),
     (5, "bad/absent description — enriched anyway|description is junk/wrong-book metadata"), (2, "no description|suspect year 900")],
)
def enrichment_doubt(df):
    d = classify.enrichment_doubt(C("known"), C("confidence"), C("note"), C("blurb"), C("proposed"), C("author"), C("year"))
    return df.select("id", d.alias("d")).select("id", "d.score", F.array_join("d.reasons", "|").alias("reasons"))


@case_query(
    "archetype", "genres array<string>, tropes array<string>, tags array<string>, spicy boolean",
    [(["Sci-Fi"], ["human-uplift"], [], False), (["Science Fiction"], [], ["slow burn"], True), (["Fantasy"], [], [], True), (["Romantasy"], ["fated-mates"], [], False), (["Fantasy"], ["found-family"], [], False), (["Fantasy"], [], [], False),
     (["Romance"], [], [], True), (["Romance"], [], [], False), (["True Crime"], [], [], True), (["Horror"], [], [], False), (["Young Adult"], [], ["dark"], False), (["Art"], [], ["Tense"], False), (["History"], [], ["hopeful"], False), (["History"], [], [], False), (None, None, None, False)],
    "archetype",
    [("The Cosmic Philosopher",), ("The Starfarer",), ("The Realm Enchanted",), ("The Realm Enchanted",), ("The Questbound",), ("The Realm Wanderer",), ("The Ardent Heart",), ("The Hopeless Romantic",), ("The Midnight Sleuth",), ("The Shadow Dweller",),
     ("The Coming-of-Ager",), ("The Twilight Reader",), ("The Quiet Contemplative",), ("The Chronicle Keeper",), ("The Eclectic Reader",)],
)
def archetype(df):
    return df.select("id", classify.archetype(C("genres"), C("tropes"), C("tags"), C("spicy")).alias("archetype"))


@case_query(
    "reclassified", "genres array<string>, tropes array<string>, tags array<string>, pacing string, spice_level string",
    [(["Sci-Fi", "Space Opera", "Thriller"], [], ["crime"], None, None), (["Fantasy", "Post Apocalyptic"], [], ["detective"], "Slow", "mild"), (["Romance"], ["slowBurn"], ["vampire", "Kindle deal"], "Fast", ""),
     (["Fantasy"], ["enemies to lovers"], [], None, None), (["History"], [], ["cafe stories"], None, "Average"), ([], [], ["space"], None, None), (["Mystery"], [], ["crime", "High heat"], None, None), (["Mystery"], ["sapphic"], ["detective"], None, None)],
    "genres, changed, confidence, tags, spice_level",
    [("Sci-Fi|Space Opera|Thriller|Mystery|crime", True, "tag-evidence", "crime", "N/A"),
     ("Fantasy|Post Apocalyptic|Mystery|crime", True, "tag-evidence", "detective|slow-paced", "Tame"),
     ("Romance|paranormal romance", False, "consistent", "vampire|slow-burn|fast-paced", "N/A"),
     ("Fantasy|Romantasy", False, "no-evidence+romance", "", "N/A"),
     ("History", False, "no-evidence", "cafe stories", "Medium Spice"),
     ("", False, "consistent", "space", "N/A"),
     ("Mystery|crime", False, "consistent", "crime", "Explicit"),
     ("Mystery|romantic suspense", False, "consistent+romance", "detective", "N/A")],
)
def reclassified(df):
    return genres.reclassified(df).select("id", F.array_join("genres", "|").alias("genres"), "changed", "confidence", F.array_join("tags", "|").alias("tags"), "spice_level")


@case_query(
    "restored_primary", "genres array<string>, source array<string>", [(["Mystery"], ["Fantasy", "War"]), (["fantasy", "x"], ["Fantasy"]), (["Dark Romance"], ["Fantasy"]), (None, ["Art"]), (["Art"], []), (["Art"], None)],
    "genres", [("Fantasy|Mystery",), ("fantasy|x",), ("Dark Romance",), ("Art",), ("Art",), ("Art",)],
)
def restored_primary(df):
    return genres.restored_primary(df, df.select("id", F.col("source").alias("genres"))).select("id", F.array_join("genres", "|").alias("genres"))


@case_query(
    "derived_tags", "tropes array<string>, tags array<string>, pacing string", [(["slowBurn", "x"], ["y"], "Slow"), (["iceQueen", "ice-queen"], [], "Medium"), ([], ["fast-paced"], "Fast"), (None, None, None), (["fakeDating", "fakeDating"], ["a", "a"], None)],
    "tags", [("y|slow-burn|slow-paced",), ("",), ("fast-paced",), ("",), ("a|a|fake-dating",)],
)
def derived_tags(df):
    return df.select("id", F.array_join(text.derived_tags(C("tropes"), C("tags"), C("pacing")), "|").alias("tags"))


@case_query("smart_title", "s string", [("DON'T STOP NOW",), ("Already Fine",), ("A1 2B",), ("",), (None,), ("123",), ("THE END: PART TWO",)], "value", [("Don't Stop Now",), ("Already Fine",), ("A1 2B",), ("",), (None,), ("123",), ("The End: Part Two",)])
def smart_title(df):
    return df.select("id", text.smart_title("s").alias("value"))


@case_query(
    "plot_section", "s string", [("Intro\n== Plot ==\nA  man\nwalks.\n=== Cast ===\nB\n",), ("x\n==Synopsis==\nonly this",), ("x\n== Reception ==\ngood",), (None,), ("a\n== story ==\n\n b \n== Plot ==\n c",)],
    "value", [("A man walks.",), ("only this",), ("",), (None,), ("b",)],
)
def plot_section(df):
    return df.select("id", text.plot_section("s").alias("value"))


@case_query("is_disambiguation", "page string, s string", [("Mercury (disambiguation)", "x"), ("Mercury", "Mercury may also refer to: many"), ("Mercury", "A planet"), ("Dune", "Dune MAY REFER TO sand")], "value", [(True,), (True,), (False,), (True,)])
def is_disambiguation(df):
    return df.select("id", text.is_disambiguation(C("page"), C("s")).alias("value"))


@case_query("names_author", "s string, author string", [("A novel by Frank Herbert.", "Frank Herbert"), ("Herberta wrote it", "Frank Herbert"), ("by HERBERT, F.", "Herbert"), ("x", None), ("by Bo Li", "Bo Li"), ("of (A.B.) King", "Stephen King")], "value", [(True,), (False,), (True,), (False,), (False,), (True,)])
def names_author(df):
    return df.select("id", text.names_author(C("s"), C("author")).alias("value"))


@case_query("genre_file", "s string", [(" Sci-Fi ",), ("Science Fiction",), ("Children's",), ("Biography & Memoir",), ("Business & Economics",), ("ROMANCE",), (None,)], "value", [("sci-fi",), ("sci-fi",), ("childrens",), ("biography-memoir",), ("business-&-economics",), ("romance",), (None,)])
def genre_file(df):
    return df.select("id", text.genre_file("s").alias("value"))


@case_query("staged_spice", "s string, levels array<string>", [("None", ["Tame", "Explicit"]), (" HIGH ", ["No Spice"]), ("low", ["N/A", "Tame"]), ("hot", []), (None, None), ("n/a", ["Medium Spice", "Tame"])], "level, hottest", [("No Spice", "Explicit"), ("Explicit", "No Spice"), ("Tame", "Tame"), (None, None), (None, None), ("N/A", "Medium Spice")])
def staged_spice(df):
    return df.select("id", text.staged_spice("s").alias("level"), text.hottest(C("levels")).alias("hottest"))


@case_query("format_author_dates", "s string", [("Melville, Herman, 1819-1891",), ("Homer, 751? BCE-651? BCE",), ("Plato",), ("Twain, Mark",), ("Doe, Jane 2nd",), ("1819-1891",)], "value", [("Herman Melville",), ("Homer",), ("Plato",), ("Mark Twain",), ("Jane 2nd Doe",), (None,)])
def format_author_dates(df):
    return df.select("id", text.format_author("s").alias("value"))


@case_query("latin_ratio", "s string", [("abc",), ("мир",), ("ab мир ф",), ("123 !",), ("",), (None,), ("Éß ñ 1",), ("ab日本",)], "value", [(1.0,), (0.0,), (0.333333,), (1.0,), (1.0,), (None,), (1.0,), (0.5,)])
def latin_ratio(df):
    return df.select("id", F.round(text.latin_share("s"), 6).alias("value"))


@case_query("percent_and_snippet", "a int, b int, s string", [(2, 3, " a\nb "), (1, 3, "long text"), (3, 3, ""), (0, 7, None)], "pct, s5", [(66, "a b"), (33, "long "), (100, ""), (0, None)])
def percent_and_snippet(df):
    return df.select("id", text.percent(C("a"), C("b")).alias("pct"), text.snippet("s", 5).alias("s5"))


@case_query("partial_ratio", "a string, b string", [("sapiens", "sapiens a brief history"), ("abc", "abc"), ("", ""), ("", "x"), ("abcd", "xbcx"), (None, "a")], "value", [(100.0,), (100.0,), (100.0,), (0.0,), (57.142857,), (None,)])
def partial_ratio_(df):
    return df.select("id", F.round(partial_ratio(C("a"), C("b")), 6).alias("value"))


@case_query(
    "blocked_terms", "raw string",
    [("star-crossed lovers",), ("touch-starved",), ("5 stars",), ("1939-1945",), ("dnf",), ("#own",), ("Kindle",), ("a",), ("2020",), ("Slow Burn",), ("re-read 2019",), ("owned books",), ("archery",), ("http://x",), ("bookish",), ("rating: 4",)],
    "blocked", [(False,), (False,), (True,), (True,), (True,), (True,), (True,), (True,), (True,), (False,), (True,), (True,), (False,), (True,), (False,), (True,)],
)
def blocked_terms(df):
    return df.select("id", is_blocked(C("raw")).alias("blocked"))


@case_query(
    "clean_description", "title string, s string",
    [("Sea", "A tale. **Books in this series** 1. One"), ("Sea", "Plot. 1. [First One][a] 2. [Second][b] 3. [Third][c]"), ("Sea", "Two [One Link][a] only."), ("Sea", "A queen. For fans of Jane Doe (Princess Jelly). The end."),
     ("Sea", "He won the Golden Award for alternate history. A war begins."), ("Best of the year", "A tale."), ("Sea", "One / A -- Two / B -- Three / C"), ("Sea", "  "), ("Sea", None), ("Sea", "Plain plot.")],
    "value", [("A tale.",), ("Plot. 1.",), ("Two [One Link][a] only.",), ("A queen.   The end.",), ("A war begins.",), (None,), (None,), (None,), (None,), ("Plain plot.",)],
)
def clean_description_(df):
    return df.select("id", clean_description(C("s"), C("title")).alias("value"))


@case_query(
    "match_context", "s string", [("short bet here",), ("x" * 50 + "  a\nbet " + "y" * 60,), ("no hit",)],
    "value", [("...short bet here...",), ("..." + "x" * 36 + " a bet " + "y" * 39 + "...",), (None,)],
)
def match_context_(df):
    return df.select("id", F.when(C("s").rlike(r"\bbet\b"), match_context(C("s"), r"\bbet\b")).alias("value"))
