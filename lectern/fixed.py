"""Values that results depend on. They are data, stated as they are."""

from __future__ import annotations

# --- fixed values: Spanish stop words, as tested after search folding -------------------
STOP_WORDS_ES = """
a al ante bajo con contra de del desde durante en entre hacia hasta mediante para por
según sin sobre tras el la los las un una unos unas y o u ni que se su sus lo le les me
te nos es son ser soy eres fue fueron ha han he hemos hay está están estoy estás como
cómo qué quién cuándo donde dónde este esta estos estas ese esa esos esas mi mí tu tú él
ella ellos ellas nosotros vosotros yo muy más menos no sí ya pero porque pues si también
""".split()

# --- fixed values: letter names dropped as words when quotes are compared ---------------
COMPARE_LETTER_NAMES = (
    "alef bet guimel dalet he vau zain jet tet yod kaf lamed mem nun sámec ain pe sade kof"
    " res sin tau"
).split()

# --- fixed values: letter names dropped in parentheses when a passage is displayed ------
DISPLAY_LETTER_NAMES = (
    "Alef Bet Guímel Guimel Dálet Dalet He Vau Zain Jet Tet Yod Kaf Lámed Lamed Mem Nun"
    " Sámec Samec Ain Pe Sade Kof Cof Res Sin Sín Shin Tau"
).split()

# --- fixed values: characters each text form removes or blanks --------------------------
SEARCH_BLANKED = "«»¿?¡!.,;:\"'()[]{}|—–-"
COMPARE_DELETED_FIRST = "«»\"'()[]"
COMPARE_DELETED_LAST = ".,;:¿?¡!—–-"

# --- fixed values: BM25 and retrieval settings ------------------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
DEFAULT_K = 8
DEFAULT_QA_K = 2
QA_MIN_SCORE = 0.5
EMBED_BATCH = 128
EARTH_RADIUS_M = 6371000.0
MAX_PLACES = 20
MAX_PHOTOS = 10

# --- fixed values: length limits ----------------------------------------------------------
TITLE_LIMIT = 200
QUESTION_LIMIT = 4000
RESPONSE_LIMIT = 8000
SEEDED_TITLE_LIMIT = 80
ANSWER_BODY_LIMIT = 2500
ANSWER_BODY_MINIMUM = 30
HEADING_MINIMUM = 10
SALVAGE_MINIMUM = 30
HISTORY_LIMIT = 10
EXPANSION_MESSAGES = 2
RECENT_LIMIT = 100

# --- fixed values: texts shown to people ---------------------------------------------------
NOTHING_FOUND = (
    "No encontré un versículo que se acerque a lo que me preguntas. "
    "¿Puedes contarme un poco más, con tus palabras?"
)
APOLOGY = "Disculpa, hubo un momento de silencio. ¿Quieres preguntarme de nuevo?"
KEEP_TALKING = "Sigamos hablando, cuéntame más."
NO_ANSWER = "No se recibió respuesta. Intenta de nuevo."
SOMETHING_WRONG = "Algo salió mal."
UNTITLED = "(sin título)"
PASSAGES_PART = "VERSÍCULOS DISPONIBLES (elige UNO y cítalo textualmente):\n\n"
QA_PART = "DOCTRINA COMPLEMENTARIA (úsala SOLO si aporta y NO la cites ni la nombres):\n\n"
QUESTION_PART = "PREGUNTA: "
REASON_UNPARSEABLE = "reference unparseable"
REASON_NOT_FOUND = "verse not found in Bible"
REASON_MISMATCH = "quoted text does not match Bible verse"
WARNING_PREFIX = "verse validation failed: "

# --- fixed values: places dropped by name or address ---------------------------------------
PLACE_EXCLUSION = "evangéli|cristian.{1,8}misionero|adventist|mormó|testigo|protestant"
MAPS_LINK = "https://www.google.com/maps/search/?api=1&query=%s,%s&query_place_id=%s"

# --- fixed values: calendar words -----------------------------------------------------------
WEEKDAYS_ES = "domingo lunes martes miércoles jueves viernes sábado".split()
MONTHS_ES = (
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"
).split()

# --- fixed values: the books of the corpus: name, abbreviation, chapters --------------------
BOOKS = [
    ("Génesis", "Gén", 50),
    ("Éxodo", "Éx", 40),
    ("Levítico", "Lev", 27),
    ("Números", "Núm", 36),
    ("Deuteronomio", "Dt", 34),
    ("Josué", "Jos", 24),
    ("Jueces", "Jue", 21),
    ("Rut", "Rut", 4),
    ("1 Samuel", "1 Sam", 31),
    ("2 Samuel", "2 Sam", 24),
    ("1 Reyes", "1 Re", 22),
    ("2 Reyes", "2 Re", 25),
    ("1 Crónicas", "1 Crón", 29),
    ("2 Crónicas", "2 Crón", 36),
    ("Esdras", "Esd", 10),
    ("Nehemías", "Neh", 13),
    ("Tobías", "Tob", 14),
    ("Judit", "Jdt", 16),
    ("Ester", "Est", 10),
    ("1 Macabeos", "1 Mac", 16),
    ("2 Macabeos", "2 Mac", 15),
    ("Job", "Job", 42),
    ("Salmos", "Sal", 150),
    ("Proverbios", "Prov", 31),
    ("Eclesiastés", "Ecl", 12),
    ("Cantar de los Cantares", "Cant", 8),
    ("Sabiduría", "Sab", 19),
    ("Eclesiástico", "Eclo", 51),
    ("Isaías", "Is", 66),
    ("Jeremías", "Jer", 52),
    ("Lamentaciones", "Lam", 5),
    ("Baruc", "Bar", 6),
    ("Ezequiel", "Ez", 48),
    ("Daniel", "Dan", 14),
    ("Oseas", "Os", 14),
    ("Joel", "Jl", 4),
    ("Amós", "Am", 9),
    ("Abdías", "Abd", 1),
    ("Jonás", "Jon", 4),
    ("Miqueas", "Miq", 7),
    ("Nahún", "Nah", 3),
    ("Habacuc", "Hab", 3),
    ("Sofonías", "Sof", 3),
    ("Ageo", "Ag", 2),
    ("Zacarías", "Zac", 14),
    ("Malaquías", "Mal", 3),
    ("Mateo", "Mt", 28),
    ("Marcos", "Mc", 16),
    ("Lucas", "Lc", 24),
    ("Juan", "Jn", 21),
    ("Hechos de los Apóstoles", "Hch", 28),
    ("Romanos", "Rom", 16),
    ("1 Corintios", "1 Cor", 16),
    ("2 Corintios", "2 Cor", 13),
    ("Gálatas", "Gal", 6),
    ("Efesios", "Ef", 6),
    ("Filipenses", "Flp", 4),
    ("Colosenses", "Col", 4),
    ("1 Tesalonicenses", "1 Tes", 5),
    ("2 Tesalonicenses", "2 Tes", 3),
    ("1 Timoteo", "1 Tim", 6),
    ("2 Timoteo", "2 Tim", 4),
    ("Tito", "Tit", 3),
    ("Filemón", "Flm", 1),
    ("Hebreos", "Heb", 13),
    ("Santiago", "Sant", 5),
    ("1 Pedro", "1 Pe", 5),
    ("2 Pedro", "2 Pe", 3),
    ("1 Juan", "1 Jn", 5),
    ("2 Juan", "2 Jn", 1),
    ("3 Juan", "3 Jn", 1),
    ("Judas", "Jud", 1),
    ("Apocalipsis", "Ap", 22),
]

# --- fixed values: the daily pool, in order --------------------------------------------------
DAILY_POOL = [
    "Sal 23:1",
    "Sal 23:4",
    "Sal 27:1",
    "Sal 27:14",
    "Sal 34:19",
    "Sal 46:11",
    "Sal 62:2",
    "Sal 91:11",
    "Sal 103:8",
    "Sal 118:24",
    "Sal 121:1",
    "Sal 121:8",
    "Sal 139:14",
    "Sal 145:18",
    "Prov 3:5",
    "Prov 16:3",
    "Ecl 3:1",
    "Sab 7:14",
    "Is 40:31",
    "Is 41:10",
    "Is 43:1",
    "Jer 29:11",
    "Lam 3:22",
    "Miq 6:8",
    "Mt 5:3",
    "Mt 6:33",
    "Mt 11:28",
    "Mt 28:20",
    "Mc 9:23",
    "Lc 1:38",
    "Lc 6:36",
    "Jn 3:16",
    "Jn 14:6",
    "Jn 14:27",
    "Jn 15:13",
    "Jn 16:33",
    "Rom 8:28",
    "Rom 8:38",
    "Rom 12:12",
    "1 Cor 13:4",
    "1 Cor 13:13",
    "2 Cor 12:9",
    "Flp 4:6",
    "Flp 4:13",
    "1 Tes 5:17",
    "Heb 13:8",
    "Sant 1:5",
    "1 Pe 5:7",
    "1 Jn 4:8",
    "1 Jn 4:18",
]
