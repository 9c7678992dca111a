"""Rule data: fixed phrase lists, in their order.  Callers can pass their own."""

# Food, and what makes it free or served.
FOOD = [
    "kolaches", "kolache", "pizza", "tacos", "taco", "barbecue", "bbq", "brisket", "donuts", "doughnuts", "donut", "bagels", "bagel", "cookies", "cookie",
    "sandwiches", "sandwich", "burgers", "burger", "wings", "chips", "queso", "ice cream", "popsicles", "cupcakes", "cake", "candy", "popcorn", "fruit",
    "coffee", "boba", "tea", "lemonade", "drinks", "beverages", "soda", "breakfast", "brunch", "lunch", "dinner", "supper", "snacks", "snack",
    "refreshments", "catering", "catered", "food", "meal", "buffet", "chick fil a", "whataburger", "raising canes", "panda express", "torchys",
]
FREE = ["free", "no cost", "at no cost", "complimentary", "on us", "free of charge", "no charge"]
PROVIDED = ["provided", "served", "will be served", "included", "available", "furnished", "catered"]
SWAG = ["swag", "free t-shirt", "free tshirt", "free shirt", "giveaways", "giveaway", "free stickers", "stickers", "free samples", "samples", "goodie bag", "goody bag", "merch", "free merch", "prizes"]
CHANCE = ["raffle", "drawing", "enter to win", "chance to win", "sweepstakes", "lottery", "door prize"]

# Words that route an event to a category, by category in order of precedence.
RECRUITING = [
    "info session", "information session", "infosession", "tech talk", "techtalk", "career fair", "careerfair", "job fair", "recruiting", "recruitment", "recruiter",
    "employer", "hiring", "internship", "internships", "co op", "coop", "networking night", "industry night", "corporate", "company visit", "on campus interview",
    "meet the firms", "mock interview", "resume review", "career expo", "office hours with",
]
SPORTS = [
    "football", "basketball", "baseball", "softball", "soccer", "volleyball", "tennis", "golf", "track and field", "cross country", "swimming", "diving", "equestrian",
    "gymnastics", "wrestling", "aggies vs", "vs texas", "game day", "kyle field", "reed arena", "olsen field", "intramural", "intramurals", "club sports",
    "spikeball", "roundnet", "badminton", "flag football", "pickleball", "ultimate frisbee", "sand volleyball", "dodgeball",
]
DEADLINES = [
    "deadline", "due date", "applications due", "apply by", "last day to", "closes", "closing", "submission deadline", "priority date", "final day",
    "scholarship", "fellowship application", "call for", "nominations",
]
RESEARCH = [
    "seminar", "colloquium", "symposium", "research", "dissertation", "thesis defense", "defense", "lecture series", "distinguished lecture", "guest lecture", "journal club",
    "poster session", "lab tour",
]
ACADEMIC = [
    "workshop", "training", "bootcamp", "short course", "tutorial", "advising", "orientation", "registration", "exam", "review session", "study abroad",
    "graduate school", "grad school", "thesis", "writing", "library", "hprc", "high performance computing", "software carpentry", "data science",
]
CLUBS = [
    "club", "student organization", "org fair", "msc", "general meeting", "gbm", "interest meeting", "callout", "social", "mixer", "game night", "movie night",
    "intramurals", "greek", "fraternity", "sorority", "residence life", "howdy week",
]
COMPANIES = [
    "google", "microsoft", "amazon", "meta", "apple", "nvidia", "intel", "ibm", "oracle", "salesforce", "adobe", "cisco", "qualcomm", "texas instruments", "ti", "dell", "hp",
    "palantir", "stripe", "databricks", "snowflake", "datadog", "atlassian", "vmware", "spacex", "blue origin", "anduril", "tesla", "rivian", "garmin", "zoox", "waymo",
    "jane street", "citadel", "two sigma", "jp morgan", "jpmorgan", "goldman sachs", "morgan stanley", "capital one", "american express", "charles schwab", "fidelity",
    "deloitte", "pwc", "ey", "kpmg", "mckinsey", "bain", "accenture", "bcg", "exxonmobil", "exxon", "chevron", "shell", "bp", "conocophillips", "phillips 66",
    "halliburton", "schlumberger", "slb", "baker hughes", "valero", "marathon", "lockheed martin", "northrop grumman", "raytheon", "boeing", "general dynamics",
    "l3harris", "honeywell", "ge", "siemens", "abb", "emerson", "caterpillar", "john deere", "bechtel", "fluor", "kiewit", "jacobs", "aecom", "hdr", "burns mcdonnell",
    "illumina", "thermo fisher", "pacific biosciences", "oxford nanopore", "10x genomics", "pfizer", "merck", "moderna", "genentech", "amgen", "regeneron", "novartis",
    "astrazeneca", "johnson johnson", "abbott", "medtronic", "bd", "baxter", "sandia", "los alamos", "lawrence livermore", "oak ridge", "argonne", "nasa", "jpl",
    "nsa", "mitre", "aerospace corporation", "idaho national laboratory", "walmart", "target", "heb", "h e b", "pepsico", "frito lay", "general mills",
    "procter gamble", "unilever", "usaa", "state farm", "geico", "aig",
]
# Words of intramural listings: the name itself, activities, and what makes a listing a concrete event.
INTRAMURAL = ["intramural", "intramurals", "intramural sports"]
ACTIVITIES = [
    "spikeball", "roundnet", "badminton", "flag football", "pickleball", "ultimate frisbee", "sand volleyball", "dodgeball", "battleship",
    "basketball", "soccer", "softball", "volleyball", "cornhole", "kickball",
]
CONCRETE = [
    "tournament", "registration", "register", "league", "free agent", "captains meeting", "captain meeting", "orientation", "playoffs",
    "championship", "competition", "challenge", "officials training",
]
# Owners that settle a category, in order; the athletics department and the recreation department by name.
ATHLETICS, RECREATION = "aggie athletics", "rec sports"
OWNERS = {
    "aggie athletics": "sports", "rec sports": "sports", "career center": "companies", "msc ": "clubs", "student activities": "clubs", "residence life": "clubs",
    "corps of cadets": "clubs", "kamu": "community", "office of undergraduate research": "research", "graduate and professional school": "academic",
    "high performance research computing": "academic",
}
