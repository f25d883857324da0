"""The regular expressions that decide what counts as a hit.

Written for java.util.regex.  ``(?U)`` makes ``\\d \\s \\b`` Unicode-aware and
``(?iuU)`` adds Unicode case folding, so offsets always refer to the unchanged
text (never lower-case a text first: some letters change length).
"""

# --- fixed values -----------------------------------------------------------
# Python also counts the separators 1C..1F as white space; Java does not.
SPACE = r"[\s\x1c-\x1f]"
SEPARATOR = r"[\s\x1c-\x1f.\-]"
# Python's word characters are letters, numbers of any kind and the underscore;
# Java's also include combining marks, so the word border is spelled out.
WORD_CHAR = r"[\p{L}\p{N}_]"
WORD_EDGE = rf"(?:(?<={WORD_CHAR})(?!{WORD_CHAR})|(?<!{WORD_CHAR})(?={WORD_CHAR}))"

TCKN_CANDIDATE = rf"(?U)(?<!\d)\d(?:{SEPARATOR}?\d){{10}}(?!\d)"

TCKN_CONTEXT = (
    r"(?iuU)(?:"
    rf"{WORD_EDGE}T\.?{SPACE}*C\.?{WORD_EDGE}"
    rf"|{WORD_EDGE}TC{WORD_EDGE}"
    rf"|{WORD_EDGE}TCKN{WORD_EDGE}"
    rf"|{WORD_EDGE}T\.?{SPACE}*C\.?{SPACE}*Kimlik{WORD_EDGE}"
    rf"|{WORD_EDGE}Kimlik{SPACE}*(?:No|Numarası|Numarasi){WORD_EDGE}"
    rf"|{WORD_EDGE}Kimlik{SPACE}*(?:No|Numarası|Numarasi){SPACE}*[:.]?"
    r")"
)
TCKN_CONTEXT_RADIUS = 40

PHONE = (
    r"(?U)(?<!\d)"
    rf"(?:(?:\+90|0090){SEPARATOR}*)?"
    r"0?"
    r"\(?[2345]\d{2}\)?"
    rf"{SEPARATOR}*\d{{3}}"
    rf"{SEPARATOR}*\d{{2}}"
    rf"{SEPARATOR}*\d{{2}}"
    r"(?!\d)"
)

EMAIL = (
    r"(?iuU)(?<![A-Za-z0-9._%+\-])"
    r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
    r"(?![A-Za-z0-9._%+\-])"
)

ADDRESS_HEADER = (
    rf"(?iuU)^{SPACE}*(?:"
    rf"ikamet{SPACE}+adresi"
    rf"|ev{SPACE}+adresi"
    rf"|yerleşim{SPACE}+yeri(?:{SPACE}+adresi)?"
    rf"|tebligat{SPACE}+adresi"
    rf"|açık{SPACE}+adres"
    r"|adres"
    rf"){SPACE}*[:\-]?"
)
STOP_HEADER = (
    rf"(?iuU)^{SPACE}*(?:"
    r"telefon|tel\.?|gsm|cep|e-?posta|e-?mail"
    rf"|t\.?{SPACE}*c\.?|tc|tckn|imza|tarih"
    rf"|adı?{SPACE}+soyadı?"
    rf"){WORD_EDGE}"
)
ADDRESS_FOLLOWING_LINES = 5
ADDRESS_GAP_RATIO = 2.5

LINE_MAX_CHARS = 120
LINE_MAX_WORDS = 12
# ----------------------------------------------------------------------------

# Cheap tests that every hit must pass; they spare most texts the full match.
TCKN_GUARD = rf"(?U)\d(?:{SEPARATOR}?\d){{10}}"
PHONE_GUARD = rf"(?U)[2345]\d{{2}}\)?{SEPARATOR}*\d{{3}}"
