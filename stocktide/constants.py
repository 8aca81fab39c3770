"""Fixed values of the reports: units, thresholds, codes and labels.

They are plain literals because the results depend on them. Everything that is
business data (town lists, SKU lists, depot names) is a parameter instead.
"""

CRORE = 10_000_000

# stock and company codes
STORAGE_LOC = "BF01"
COMPANY_CODE = 1532
CP_MATERIAL_GROUP = "F070"

# thresholds
LOCK_LOWER_DEFAULT = 50.0
LOCK_UPPER_DEFAULT = 100.0
DISPATCH_RATE_FLOOR = 85.0
NO_ORDER_RATE = 9999.0
TARGET_DOH = 18
LOW_DOH = 10
TRAILING_DAYS = 5
TOWN_LIST_WIDTH = 40
TOP_ORDERED = 7
TOP_SCORECARD = 10
TOP_PACKS = 50

# labels
WEEKDAYS = ("SAT", "SUN", "MON", "TUE", "WED", "THU", "FRI")
CLASS_DEFAULT = "D"
CLASS_WINTER = "Winter"
NMSM_DEFAULT = "No NMSM TAG"
STATUS_UPDATED, STATUS_MISSING = "Update", "Not Update"
DEFAULTER, ACTIVE = "Defaulter", "Active"
NO_ORDER = "No-Order"
LOSS_AVAILABLE = "Stock available"
LOSS_NO_ORDER = "No-Order from Customer"
LOSS_SUPPLY = "Supply Issue"
LOSS_TRANSIT = "Stock in transit"
RUNNING_CP_LABEL, OLD_CP_LABEL, NON_CP_LABEL = "running CP", "old CP", "non CP"
FULL_STOCK_LOSS, PARTIAL_STOCK_LOSS = "full stock loss", "partial stock loss"
SERVICE_LOSS, UNIDENTIFIED_LOSS = "service loss", "unidentified loss"
PORTFOLIOS = ("A", "B", "C", "D", "overall")
