"""Fixed values as the SQL of ``oracles`` knows them, written out apart from those of the code, so that a wrong entry of either shows."""

# --- fixed values: look-alikes of the zone, in the order in which they are tried ---
CONFUSIONS = {
    "0": "OQDU86",
    "1": "IL|T7",
    "2": "Z47",
    "3": "58E",
    "4": "2A6",
    "5": "S36",
    "6": "Gb405",
    "7": "1T",
    "8": "B30",
    "A": "4",
    "B": "8",
    "D": "0O",
    "G": "6",
    "I": "1L|T",
    "L": "1I",
    "O": "0QD",
    "Q": "0O",
    "S": "5",
    "T": "17I",
    "U": "0",
    "Z": "27",
    "|": "1I",
}
#: Digits read for letters at the first and second place of a document number, letters read for digits at the others.
FIRST_DIGITS, FIRST_LETTERS = "0124578", "OIZASTB"
SECOND_DIGITS, SECOND_LETTERS = "01234578", "OIZEASTB"
TAIL_LETTERS, TAIL_DIGITS = "ABDGILOQSTZ", "48061100512"
CHALLENGES = ("BLINK", "LOOK_LEFT", "LOOK_RIGHT", "MOVE_AWAY", "MOVE_CLOSER", "SMILE")
NAME_SUFFIXES = "ALI AT BEK BOY DOR EVA GUL IDDIN ILA INA ISA IYA JON MIRZO NOZ NUR ORA OVA OYA SHOD UDDIN ULLAH ULLO URA XAN XON ZOD ZODA".split()
PAIRS = "4A 0O 0D 1I 1L 2Z 5S 8B 6G".split()
MONTHS = "04 06 01 07".split()
DAYS = "02 04 12 14 21 22 24 27".split()
# --- end of fixed values ---
