"""Fixed values of the domain: word lists, lookup tables, weights and patterns.

Results depend on these being exactly what they are, so they are kept together and in plain form.
Patterns use the JVM regex dialect; ``(?iuU)`` gives Unicode case folding and Unicode word classes.
"""

# --- fixed values: match scoring -------------------------------------------------------------
# Shares of the final score, in 1/2000 units so that sums stay integers.
SCORE_UNIT = 2000
W_SLOT, W_BUDGET, W_COUNTRY, W_CONDITION, W_SIZE, W_WORDS = 800, 500, 300, 160, 140, 100
BUDGET_TOLERANCE = 1.15
SIZE_TOLERANCE_CM = 4
MIN_SCORE = 0.5
TOP_MATCHES = 20
KEYWORD_PATTERN = "[a-zа-яё]{4,}"
MATCH_STOP_WORDS = [
    "продам", "куплю", "ищу", "нужен", "нужна", "suche", "gezocht", "larp", "ларп",
    "mittelalter", "verkaufe", "neu", "gebraucht",
]

# --- fixed values: currencies ----------------------------------------------------------------
# USD per one unit, used where no live rate is known.
FALLBACK_USD_PER = {
    "USD": 1.0, "RUB": 1.0 / 90.0, "EUR": 1.09, "KZT": 1.0 / 470.0, "UAH": 1.0 / 41.0, "GBP": 1.27,
    "PLN": 1.0 / 4.0, "INR": 1.0 / 84.0, "CZK": 1.0 / 23.0, "CHF": 1.12, "JPY": 1.0 / 155.0,
    "NZD": 0.60, "MMK": 1.0 / 2100.0, "UZS": 1.0 / 12700.0, "SAR": 1.0 / 3.75, "AED": 1.0 / 3.6725,
    "QAR": 1.0 / 3.64, "AZN": 1.0 / 1.70, "JOD": 1.0 / 0.709, "TJS": 1.0 / 10.6, "BRL": 1.0 / 5.5,
    "BYN": 1.0 / 3.3, "GEL": 1.0 / 2.7, "CAD": 1.0 / 1.37, "TRY": 1.0 / 34.0, "CNY": 1.0 / 7.2,
    "RSD": 1.0 / 108.0,
}
SUPPORTED_CURRENCIES = sorted(FALLBACK_USD_PER)
CURRENCY_ALIASES = {
    "RUR": "RUB", "USDT": "USD", "USDC": "USD", "$": "USD", "€": "EUR", "SO'M": "UZS", "СУМ": "UZS",
    "KČ": "CZK", "KC": "CZK", "₴": "UAH", "ГРН": "UAH", "ГРН.": "UAH", "TL": "TRY", "₸": "KZT",
    "ТГ": "KZT", "ТГ.": "KZT", "ТЕНГЕ": "KZT", "KZT.": "KZT", "₽": "RUB", "РУБ": "RUB",
    "РУБ.": "RUB", "Р.": "RUB", "£": "GBP",
}
PERIOD_TOKENS = [
    "МЕС", "МЕС.", "МЕСЯЦ", "/МЕС", "В МЕСЯЦ", "ЧАС", "ЧАС.", "/ЧАС", "В ЧАС", "ГОД", "ГОД.", "/ГОД",
    "В ГОД", "ГОДОВЫХ", "MONTH", "/MONTH", "PER MONTH", "MO", "HOUR", "/HOUR", "PER HOUR", "HR",
    "YEAR", "/YEAR", "PER YEAR", "YR", "ANNUAL", "P.A.", "DAY", "/DAY", "PER DAY", "ДЕНЬ", "/ДЕНЬ",
    "В ДЕНЬ", "СМЕНА", "ЗА СМЕНУ",
]
MULTIPLIER_TOKENS = ["K", "К", "MING", "ТЫС", "ТЫС.", "THOUSAND"]
APOSTROPHES = "'’‘ʻʼ′´`"
HOURS_PER_MONTH = 168

# --- fixed values: price phrases -------------------------------------------------------------
PRICE_CURRENCY_PATTERNS = [
    ("RUB", r"₽|руб(?:л(?:ей|я|ях|ь))?|\brub\b|\brur\b"),
    ("USD", r"\$|\busd\b|доллар"),
    ("EUR", r"€|\beur\b|евро"),
    ("KZT", r"₸|\bkzt\b|тенге"),
    ("GBP", r"£|\bgbp\b|фунт"),
]
PRICE_PERIOD_PATTERNS = [
    ("hour", r"/\s*(?:ч(?:ас)?|h(?:our|r)?)\b|в\s+час|per\s+hour"),
    ("year", r"/\s*(?:год|year|yr)|в\s+год|per\s+year|годов(?:ых|ой)|annual|p\.?a\.?"),
    ("month", r"/\s*(?:мес(?:яц)?|months?|mo)\b|в\s+месяц|per\s+month"),
]
PRICE_NET_PATTERN = r"на\s+руки|чист(?:ыми|ая)|\bnet\b|после\s+налог|after\s+tax"
PRICE_GROSS_PATTERN = r"\bgross\b|до\s+вычет|до\s+налог|гросс|грязными|before\s+tax"
PAY_WORD_PATTERN = (
    r"зарплат|зарплатн|з\.?/?п\b|зп\b|оклад|вилк|доход|ставк|получа|платим|"
    r"оплат|salary|payment|compensation|rate\b|бюджет"
)
PAY_WINDOW = 40

# --- fixed values: listing classification ----------------------------------------------------
WANT_PATTERN = (
    r"\b(ищу|куплю|купим|нужен|нужна|нужны|в поиске|suche|gesucht|kaufe|gezocht|ik zoek|wij zoeken|"
    r"wtb|looking for|wanted|szukam)\b"
)
SELLER_COPY_PATTERN = (
    r"\b(ben jij|bent u|are you|bist du|sind sie)\s+(op zoek|looking|auf der suche)\b"
)
USED_PATTERN = (
    r"\b(б/у|бу|б\.у\.|used|second[- ]hand|gebraucht|gebrauchsspuren|gebrauchter|gebrauchte|gebruikt|"
    r"tweedehands|getragen|benutzt|wenig genutzt|bespielt|pre-owned|worn)\b"
)
NEW_PATTERN = r"\b(новый|новая|новое|new|neu|neuwertig|ungetragen|nieuw|ovp|unbenutzt)\b"
NEGATION_PATTERN = (
    r"\b(nicht|kein|keine|не|no|not)\s+(?:mehr\s+)?(gebraucht|used|б/у|new|neu)\b"
)
SALE_PATTERN = (
    r"\b(продам|продаю|продаётся|продается|продажа|куплю|отдам|обменяю|сдам в аренду|сдаю|verkaufe|"
    r"zu verkaufen|suche|tausche|te koop)\b"
)
DIGEST_PRICE_PATTERN = r"\d+\s*(?:€|eur|₽|руб|тг|₸|грн|zł|\$)"
DIGEST_MIN_PRICES, DIGEST_MIN_BULLETS = 4, 5
GATED_SOURCE_KINDS = ["tg", "vk", "calendar"]
MIN_TEXT_CHARS = 8
DIRECTION_HEAD, FEED_GATE_HEAD = 200, 300

# --- fixed values: services ------------------------------------------------------------------
SERVICE_PATTERNS = [
    ("rent", r"\b(аренд\w*|прокат\w*|напрокат|rent(?:al)?|verleih|huur|te huur)\b"),
    ("repair", r"\b(ремонт\w*|починк\w*|реставрац\w*|repair|reparatur|reparatie)\b"),
    ("refit", r"\b(подгонк\w*|подогнать|refit|anpassung)\b"),
    ("custom", r"\b(на заказ|под заказ|изготовлен\w* на заказ|индивидуальн\w* пошив|custom order|"
               r"made to order|maßanfertigung|op maat)\b"),
    ("event", r"\b(мастер-класс\w*|мастеркласс\w*|консультац\w*|мероприят\w*|тир|ярмарк\w*|городок|"
              r"workshop|event)\b"),
    ("appraisal", r"\b(оценк\w*|экспертиз\w*|appraisal)\b"),
]
SERVICE_TITLE_PATTERN = (
    r"\b(в аренду|напрокат|прокат\w*|аренда\b|услуг\w*|мастер-класс\w*|te huur|zu vermieten|for hire|"
    r"for rent)\b"
)

# --- fixed values: vocabulary ----------------------------------------------------------------
# (slot, label, aliases). Cyrillic aliases are stems: their tail stays open for inflection.
SLOT_VOCABULARY = [
    ("sword_1h", "Sword", ["меч", "палаш", "гладиус", "каролинг", "вакидзаси", "sword", "rapier", "schwert", "zwaard"]),
    ("axe", "Axe", ["топор", "axe", "axt", "bijl"]),
    ("dagger", "Dagger", ["кинжал", "dagger", "dolch"]),
    ("bow", "Bow", ["лук", "bow", "bogen"]),
    ("shield", "Shield", ["щит", "shield", "schild"]),
    ("helmet", "Helmet", ["шлем", "бацинет", "салад", "helmet", "helm"]),
    ("cuirass", "Cuirass", ["кираса", "breastplate", "cuirass", "harnas"]),
    ("gambeson", "Gambeson", ["поддоспешник", "гамбезон", "gambeson"]),
    ("chainmail", "Chainmail", ["кольчуга", "chainmail", "kettenhemd"]),
    ("bracers", "Bracers", ["наручи", "bracers", "armschienen"]),
    ("tunic", "Tunic", ["котта", "tunic", "wappenrock", "wappenröcke"]),
    ("cloak", "Cloak", ["плащ", "cloak", "umhang"]),
    ("boots", "Boots", ["сапоги", "boots", "stiefel"]),
    ("belt", "Belt", ["пояс", "sword belt", "gürtel"]),
    ("scabbard", "Scabbard", ["ножны", "scabbard", "rapier holder", "schwert-halter", "scheide"]),
    ("quiver", "Quiver", ["колчан", "quiver", "köcher"]),
    ("jewelry", "Jewelry", ["фибула", "подвески", "амулет", "choker", "brooch"]),
    ("banner", "Banner", ["знамя", "banner", "battle standard"]),
    ("kit", "Complete set", ["комплект доспехов", "complete set", "standard set"]),
    ("tent", "Tent", ["шатёр", "tent", "zelt"]),
    ("weapon_other", "Weapon", ["оружие", "weapon", "waffe"]),
    ("costume", "Costume", ["костюм", "costume", "kostuum"]),
]
CONTAINER_SLOTS = ["scabbard", "quiver", "jewelry", "belt", "kit", "banner"]
GENERIC_SLOTS = ["weapon_other", "costume", "other_misc"]
STEM_PATTERN = "^[а-яё]{4,}[аяыиоеьй]$"
INCLUDED_ACCESSORY_PATTERN = (
    r"\b(?:с|со|в)\s+(?:[а-яё]+ыми\s+|[а-яё]+ых\s+)?(?:ножн\w*|чехл\w*|подвес\w*|поясом|ремн\w*)\b"
    r"|\bwith\s+(?:scabbard|sheath|holder|belt|frog)\b"
    r"|\bmit\s+(?:scheide|halter|gürtel|halterung)\b"
    r"|\bmet\s+(?:schede|houder|riem)\b"
)
#: Every such phrase has one of these.
INCLUDED_ACCESSORIES = ["ножн", "чехл", "подвес", "поясом", "ремн", "scabbard", "sheath", "holder", "belt", "frog", "scheide", "halter", "gürtel", "schede", "houder", "riem"]
# Last part of a German or Dutch compound noun -> slot; the later entry wins on a repeat.
COMPOUND_HEADS = [
    ("schwert", "sword_1h"), ("säbel", "sword_1h"), ("katana", "sword_1h"), ("axt", "axe"),
    ("beil", "axe"), ("dolch", "dagger"), ("messer", "dagger"), ("hammer", "mace_hammer"),
    ("kolben", "mace_hammer"), ("keule", "mace_hammer"), ("speer", "spear"), ("lanze", "spear"),
    ("hellebarde", "polearm"), ("stab", "staff"), ("schild", "shield"), ("bogen", "bow"),
    ("armbrust", "crossbow"), ("pfeil", "arrows"), ("helm", "helmet"), ("haube", "helmet"),
    ("hemd", "tunic"), ("wams", "gambeson"), ("rüstung", "cuirass"), ("panzer", "cuirass"),
    ("platte", "cuirass"), ("handschuh", "gloves"), ("stiefel", "boots"), ("schuh", "boots"),
    ("umhang", "cloak"), ("mantel", "cloak"), ("kleid", "dress"), ("rock", "dress"),
    ("hose", "trousers"), ("mütze", "headwear"), ("hut", "headwear"), ("gürtel", "belt"),
    ("beutel", "pouch"), ("tasche", "pouch"), ("halter", "scabbard"), ("scheide", "scabbard"),
    ("kette", "jewelry"), ("ring", "jewelry"), ("zelt", "tent"), ("maske", "mask"),
    ("laterne", "camp_gear"), ("becher", "camp_gear"), ("krug", "camp_gear"),
    ("zwaard", "sword_1h"), ("schild", "shield"), ("harnas", "cuirass"), ("kostuum", "costume"),
    ("wapen", "weapon_other"), ("bijl", "axe"), ("dolk", "dagger"), ("boog", "bow"),
    ("speer", "spear"), ("staf", "staff"), ("kolder", "chainmail"), ("kraag", "gorget"),
    ("gordel", "belt"), ("tasje", "pouch"), ("laars", "boots"), ("hoed", "headwear"),
    ("masker", "mask"), ("handschoen", "gloves"), ("jurk", "dress"), ("pak", "costume"),
    ("pruik", "costume"),
]

# --- fixed values: near-duplicate detection --------------------------------------------------
HAMMING_THRESHOLD = 8
RETENTION_DAYS = 30
SIMHASH_MIN_TOKENS = 8
DEDUP_STOP_WORDS = [
    "в", "на", "с", "и", "а", "но", "по", "за", "к", "у", "от", "до", "из", "при", "об", "что", "как", "для", "или", "не", "же", "то", "так", "это",
    "этот", "его", "её", "их", "вы", "мы", "the", "a", "an", "and", "or", "of", "to", "in", "for", "is", "are", "with", "on", "at", "by", "as", "be",
    "we", "our", "num", "вакансия", "вакансии", "резюме", "компания", "компании", "организация", "зарплата", "зп", "оплата", "вилка", "опыт",
    "требования", "требование", "обязанности", "условия", "условие", "формат", "контакт", "контакты", "стек", "технологии", "технология", "позиция",
    "должность", "проект", "предлагаем", "предлагаю", "описание", "писать", "пишите", "напишите", "написать", "пиши", "напиши", "ищем", "ищу",
    "нужен", "нужна", "нужны", "разыскивается", "приглашаем", "приглашаю", "рассматриваю", "рассматриваем", "года", "лет", "год", "месяц", "месяцев",
    "удалённо", "удаленно", "полностью", "гибрид", "офис", "remote", "hybrid", "office", "full", "fully", "наша", "наш", "наши", "наше",
]

# --- fixed values: dates, tags and periods ---------------------------------------------------
DUTCH_MONTHS = {"jan": 1, "feb": 2, "mrt": 3, "apr": 4, "mei": 5, "jun": 6, "jul": 7, "aug": 8,
                "sep": 9, "okt": 10, "nov": 11, "dec": 12}
ROMAN_CENTURIES = {"IX": 9, "X": 10, "XI": 11, "XII": 12, "XIII": 13, "XIV": 14, "XV": 15, "XVI": 16,
                   "XVII": 17}
TAG_DISCIPLINES = [("мечевой бой", "hmb"), ("реконструкция", "reenact"), ("фехтование", "hema"),
                   ("ларп", "larp"), ("игры", "larp")]
TAG_IGNORED = ["нри", "ролевые"]
TAG_COUNTRIES = {"сербия": "RS", "москва": "RU", "липецкая обл.": "RU", "россия": "RU"}

# --- fixed values: registry views ------------------------------------------------------------
FACET_TOP = 12
HISTOGRAM_BINS = 22
HISTOGRAM_EMPTY_MAX = 100000
SCARCITY_TOP = 7
GAP_TOP = 6
ONLY_WANTS_RATIO = 99.0
REFIT_TOLERANCE = 4
FEED_MAX_LOTS = 5000
HOME_SHARE = 0.6
SERVICES_TOP = 4
SIMILAR_TOP = 5
UNDATED_YEAR = 9999
FEED_MEASURES = ["length_cm", "blade_cm", "weight_g", "hardness_shore_a", "chest_cm", "head_cm"]
MODEL_PRICES = {  # USD per million tokens: input, cached input, output
    "deepseek-v4-flash": (0.27, 0.07, 1.10),
    "deepseek-v4-pro": (0.55, 0.14, 2.19),
    "deepseek-chat": (0.27, 0.07, 1.10),
    "deepseek-reasoner": (0.55, 0.14, 2.19),
}
MODEL_DEFAULT_PRICE = (0.27, 0.07, 1.10)
