import pytest

from pagesieve.llm import residue as R

PROSE = " ".join(["The billing portal explains the second step of the sign-in before the page is shown."] * 6)
SCHEMA = "id string, title string, visible_text string, captured_at timestamp, ingested_at timestamp, kind string"


def _found(spark, rows):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    rows = [(i, title, text, t + dt.timedelta(days=d), t, "x") for i, title, text, d in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["id"] for r in R.template_residue(df, "id", "title", "visible_text", ["captured_at", "ingested_at"]).collect()}


@pytest.mark.parametrize("p", ["{{name}}", "${a.b}", "%%CITY%%", "[First Name]", "<%= x %>", "*|CITY|*", "~city~", "<<Order Number>>", "@@a@@", "__USER_NAME__", "[object Object]", "#{x}", "$[x]", "{city}"])
def test_placeholders(spark, p):
    assert _found(spark, [("a", None, f"{PROSE} Dear {p}, your parcel is ready.", 0), ("b", p, PROSE, 0), ("c", None, f"{PROSE} In a template you write '{p}' and the tool puts the value in.", 0), ("d", "x", PROSE, 0)]) == {"a", "b"}


def test_program_values_by_alignment(spark):
    rows = [("a", None, f"{PROSE} Write to {{{{x}}}} at any time.", 0), ("b", None, f"{PROSE} Write to %%Y%% at any time.", 0), ("c", None, f"{PROSE} Write to NaN at any time.", 0)]
    rows += [("d", None, f"{PROSE} An undefined value in the form was the cause.", 0), ("e", "undefined", PROSE, 0), ("f", None, f"{PROSE} We write None of it down.", 0)]
    assert _found(spark, rows) == {"a", "b", "c", "e"}


@pytest.mark.parametrize(
    "text",
    ["Please enable JavaScript to continue.", "Bitte aktivieren Sie Skripte, um diese Seite zu nutzen.", "Cette page ne fonctionne pas sans scripts.", "Activa JavaScript del navegador para ver esta página.", "The requested path /x was not found on this server.",
     "No tiene permiso para ver este recurso.", "Your text goes here. Click to edit.", "Dapibor lorem tinciden ipsum aliquor dolor.", "Index of /x Name Last modified Size Parent Directory"],
)
def test_whole_pages(spark, text):
    around = "Home Contact About us. {} We use cookies to remember your choices. Privacy © 2020 X"
    assert _found(spark, [("a", "T", around.format(text), 0), ("b", "T", f"{PROSE} Comments are shown only if you enable JavaScript, but the article is complete.", 0)]) == {"a"}


def test_edges(spark):
    assert _found(spark, [("n", None, None, 0), ("e", "", "", 0), ("t", "x", "", 0)]) == set()
    # the latest state counts
    assert _found(spark, [("a", None, "Error 404. The page was not found.", 0), ("a", None, PROSE, 3), ("b", None, PROSE, 0), ("b", None, "Error 404. The page was not found.", 3)]) == {"b"}
    assert _found(spark, [("l", None, PROSE * 2000 + " Hola {{x}}, adios.", 0)]) == {"l"}
    assert R.template_residue(spark.createDataFrame([], SCHEMA), "id", "title", "visible_text", ["captured_at", "ingested_at"]).count() == 0


@pytest.mark.parametrize("filler, found", [("", True), ("§NAME§", True), ("<:first name:>", True), ("first_name", True), ("$name", True), ("¿name?", False), ("Anna", False), ("'§NAME§'", False)])
def test_blanks_and_unlisted_syntaxes_in_slots(spark, filler, found):
    rows = [("a", None, f"{PROSE} Dear {{{{x}}}}, your parcel is ready.", 0), ("b", None, f"{PROSE} Dear %%Y%%, your parcel is ready.", 0), ("c", None, f"{PROSE} Dear {filler}, your parcel is ready.", 0)]
    # the same where no placeholder makes a slot
    rows += [("d", None, f"{PROSE} We ship {filler}, which pleases every customer.", 0)]
    assert _found(spark, rows) == ({"a", "b", "c"} if found else {"a", "b"})


def test_doubled_blank_in_a_slot(spark):
    rows = [("a", None, f"{PROSE} Write to {{{{x}}}} at any time.", 0), ("b", None, f"{PROSE} Write to %%Y%% at any time.", 0), ("c", None, f"{PROSE} Write to  at any time.", 0), ("d", None, f"{PROSE} Write  it at any time.", 0)]
    assert _found(spark, rows) == {"a", "b", "c"}


POLISH = "Sklep Kontakt Pomoc {} Przepraszamy, strona {} nie istnieje na tym serwerze Polityka Regulamin © 20{} X"


def test_repeated_whole_pages_in_any_language(spark):
    rows = [(f"p{k}", "Ups", POLISH.format("Blog" * (k % 3), f"/a{k}", 10 + k), 0) for k in range(6)]
    # content that speaks of it, menus that repeat everywhere, and a short page that repeats only its menu
    rows += [(f"c{k}", "T", f"Sklep Kontakt Pomoc Polityka Regulamin i inne dobre rzeczy w naszym sklepie {k}. {PROSE}", 0) for k in range(60)]
    rows += [(f"s{k}", "T", f"Sklep Kontakt Pomoc Polityka Regulamin i inne dobre rzeczy w naszym sklepie {k}.", 0) for k in range(6)]
    assert _found(spark, rows) == {f"p{k}" for k in range(6)}
    # copies of one text are one text
    assert _found(spark, [(f"p{k}", "Ups", POLISH.format("", "/a", 10), 0) for k in range(6)]) == set()


@pytest.mark.parametrize("filler, found", [("", True), ("§NAME§", True), ("Customer Name", True), ("_____", True), ("Zoe", False), ("'§NAME§'", False)])
def test_slots_by_varying_fillers(spark, filler, found):
    rows = [(f"v{k}", None, f"{PROSE} Good morning {n}, your parcel is ready.", 0) for k, n in enumerate(["Anna", "Bob", "Carla Maria", "Dan", "Eve"])]
    rows += [("x", None, f"{PROSE} Good morning {filler}, your parcel is ready.", 0), ("y", None, f"{PROSE} We ship {filler}, which pleases everyone.", 0)]
    assert _found(spark, rows) == ({"x"} if found else set())


def test_same_filler_everywhere_is_no_slot(spark):
    rows = [(f"v{k}", None, f"{PROSE} Good morning Anna, your parcel is ready.", 0) for k in range(6)] + [("x", None, f"{PROSE} Good morning , your parcel is ready.", 0)]
    assert _found(spark, rows) == set()


def test_sentences_are_read_whole():
    long = "word " * 400
    context, quoted, left, right = R._context(f"Start. In a template {long}we put {{{{x}}}} there {long}end. Next", 0 + len(f"Start. In a template {long}we put "), len(f"Start. In a template {long}we put {{{{x}}}}"), False)
    assert left.startswith("In a template") and right.strip().endswith("end.")
    assert R.residue_hits("", f"In a template {long}we put {{{{x}}}} there.")[0][2]
