from tessera.llm.scans import Scans, difference, header_key, number_of, page_number, paragraphs, skeleton, undo

BODY = ["O grande caçador cruza a floresta", "e depois espera a chuva do inverno", "com o lusco-fusco no caminho."]


def book(spark):
    pages = []
    for n in range(1, 13):
        lines = [f"Crônica das feras de Tinanu   {n}" if n != 5 else f"Crôníca das feras de Tinanu   {n}"]
        body = list(BODY)
        if n == 2:
            body = ["O grande caça-", "dor cruza a floresta e", "espera o lusco-", "fusco no caminho"]
        if n == 3:
            body = ["O grande c@çador cruza a flore-", "sta e depois espera a chuva do", "inverno com o mestre de depois flo-"]
        if n == 4:
            body = ["resta e cntão o caçador espera.", "GRANDE CAÇADOR", "FOR", "12", *BODY]
        pages.append((n, "b", n, None, [*lines, *body], None))
    pages += [(20, "b", 6, None, [], None), (21, "c", 1, "só texto\nsem linhas", None, None), (22, "c", 2, None, None, None), (23, None, None, None, ["xyz", None, ""], None)]
    for n in range(1, 30):
        pages.append((100 + n, "d", n, None, ["e então o caçador espera", *BODY, f"• {n} •"], None))
    return spark.createDataFrame(pages, "page_id bigint, book string, number int, text string, lines array<string>, key string")


def test_noise(spark):
    got = {(r.page_id, r.line_no, r.noise) for r in Scans(book(spark)).found().collect()}
    assert {(n, 1, "running_header") for n in range(1, 13)} <= got and len([g for g in got if g[2] == "running_header"]) == 12
    assert {(100 + n, 5, "page_number") for n in range(1, 30)} == {g for g in got if g[2] == "page_number"}
    assert {g for g in got if g[2] == "hyphen_break"} == {(2, 2, "hyphen_break"), (3, 2, "hyphen_break"), (3, 4, "hyphen_break")}
    assert {g for g in got if g[2] == "ocr_char"} == {(3, 2, "ocr_char"), (4, 2, "ocr_char")}


def test_paragraphs(spark):
    got = [r.text for r in paragraphs(book(spark)).where("book = 'b'").orderBy("paragraph").collect()]
    text = "\n".join(got)
    assert "Crônica" not in text and "caçador cruza a floresta e depois" in text and "lusco-fusco no caminho" in text and "depois floresta e então" in text


def test_pieces():
    assert number_of("xiv") == (14, True) and number_of("l5") == (15, False) and number_of("abc") is None
    assert page_number("— 12 —") == ("trim", 12, False) and page_number("pág. 3 / 70") == ("page", 3, False) and page_number("Página l5") == ("page", 15, False)
    assert page_number("FOR 16") is None and page_number("por 18 dias.") is None
    assert header_key("12   Bestiário de Duneni")[0] == header_key("Bestíário de Duneni   xiv")[0]
    assert skeleton("caminho") == skeleton("carninho") and skeleton("docas") == skeleton("clocas")
    assert {"escriba"} <= undo("cscriba") and "barril" in undo("banil") and "além" in undo("al6m") and "livro" in undo("li\\/ro")
    assert difference("c@sa", "casa") == (1, 2) and difference("cscriba", "escriba") == (0, 1)


def test_empty(spark):
    assert Scans(book(spark).limit(0)).found().count() == 0
    assert paragraphs(book(spark).limit(0)).count() == 0
