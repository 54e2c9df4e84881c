"""Fixed values that results depend on: weights, thresholds, word lists, patterns. Plain, in one place."""

# --- scoring -------------------------------------------------------------------------------------------------------
SEVERITY_WEIGHT = {"error": 10, "warning": 3, "notice": 1}
SEVERITY_RANK = {"error": 0, "warning": 1, "notice": 2}
CATEGORY_WEIGHT = {
    "indexability": 3.0, "meta": 2.5, "content": 2.5, "performance": 2.0, "mobile": 2.0, "links": 1.6, "architecture": 1.6, "structured": 1.5,
    "security": 1.4, "usability": 1.4, "accessibility": 1.2, "geo": 1.2, "international": 1.0, "local": 1.0, "social": 0.8, "url": 0.8,
}
SCORE_CURVE = 9
SITE_GRADES = ((90, "A"), (75, "B"), (60, "C"), (45, "D"))
CONTENT_GRADES = ((90, "A"), (80, "B"), (65, "C"), (50, "D"))

# --- text ----------------------------------------------------------------------------------------------------------
FOLD_FROM, FOLD_TO = "ąćęłńóśżź", "acelnoszz"
TEXT_STOP = "i oraz w we na do z ze a o u od po za dla pod nad the and or of to in for an jak co czy jest sa lub albo ale bez przy przez jako aby wiec gdzie kiedy sie jego jej ich tym ten ta te tej jakie twoj twoja nasz nasza"
TEXT_SUFFIXES = "ami ach om owi ego emu iego iemu owie ych ymi imi owy owa owe iej ej im ym em mi ie a e i y o u"
KEYWORD_STOP = "i oraz w we na do z ze a o u od po za dla pod nad the and or of to in for an jak co czy że jest są lub albo ale bez przy przez jako aby więc gdzie kiedy"
KEYWORD_SUFFIXES = "ialbo owieni owych owymi iejszy iejsza ami ach om owi ego emu iego iemu owie ych ymi imi owy owa owe iej ej im ym em mi ia ie a e i y o u"
TITLE_STOP = "i oraz w na do z dla the and of a o po za"
FLUFF = (
    r"w dzisiejszym (dynamicznie )?(zmieniaj[aą]cym si[eę] )?świecie",
    r"w dzisiejszych czasach",
    r"w erze cyfrow[ej]",
    r"nie da si[eę] ukry[ćc]",
    r"warto (jednak )?(pami[eę]ta[ćc]|zauważy[ćc]|podkre[śs]li[ćc]|wiedzie[ćc])",
    r"jak (powszechnie )?wiadomo",
    r"bez (dwóch|w[aą]tpienia) zdań?",
    r"odgrywa(j[aą])? (kluczow[aą]|istotn[aą]|ważn[aą]) rol[eę]",
    r"w (dynamicznym|szybko zmieniaj[aą]cym si[eę]) (świecie|środowisku)",
    r"in today'?s (fast-paced |digital |ever-changing )?world",
    r"it'?s (important|worth) (to note|noting|mentioning)",
    r"when it comes to",
    r"at the end of the day",
    r"plays? a (crucial|key|vital|important) role",
    r"in the (ever-changing|modern|digital) (world|landscape|era)",
)
UNIT = r"[0-9]+([.,][0-9]+)?[ \t\n\r]?(%|proc|tys|mln|mld|zł|pln|eur|usd|\$|€|kg|km|godz|lat|osób|razy)"
PERCENT = r"[0-9]+([.,][0-9]+)?[ \t\n\r]?%"
CAPITAL, SMALL = "A-ZĄĆĘŁŃÓŚŻŹ", "a-ząćęłńóśżź"

# --- patterns over URLs, anchors and titles ------------------------------------------------------------------------
GENERIC_ANCHOR = r"^(kliknij|kliknij tutaj|tutaj|tu|więcej|czytaj więcej|zobacz|zobacz więcej|sprawdź|click here|here|read more|more|link)[ \t\n\r]*$"
AUTHORITY = r"\.(gov|edu|edu\.pl|gov\.pl|gob\.|ac\.uk|int)(/|$)|(^|[^a-z0-9_])(wikipedia\.org|who\.int|europa\.eu|nih\.gov|nasa\.gov|britannica\.com|reuters\.com|nature\.com|sciencedirect\.com|ncbi\.nlm\.nih\.gov)([^a-z0-9_]|$)"
PAGINATED = r"([?&](page|strona|p)=[0-9]+)|/(page|strona)/[0-9]+|/[0-9]+/?$"
ASKS = r"^(jak|co|dlaczego|ile|czy|kiedy|gdzie|jaki|który|czym|po co|na co|za ile)([^a-z0-9_]|$)"
MODIFIERS = {
    "commercial": r"(^|[^a-z0-9_])(cena|cennik|tanio|tani|sklep|kup|kupić|promocja|oferta|koszt|ranking|najlepsz)([^a-z0-9_]|$)",
    "guide": r"(^|[^a-z0-9_])(jak|poradnik|krok|instrukcja|sposób|domowy|samodzielnie)([^a-z0-9_]|$)",
    "local": r"(^|[^a-z0-9_])(warszawa|krakow|kraków|wrocław|poznań|gdańsk|blisko|okolica|w pobliżu)([^a-z0-9_]|$)",
}
TYPE_ORDER = "blog service product category location page"
CAMERA_NAME = r"/(img|image|dsc|dscn|photo|pic|screenshot)[-_]?[0-9]{2,}|/[0-9]{4,}\.(jpe?g|png|webp|avif)"
NOT_PAGINATED = r"/(19|20)[0-9]{2}/?$"
TITLE_NUMBER = r"(strona|page|str\.?|—|-|\|)[ \t]*[0-9]+"
LOOKS_LOCAL = r"kontakt|contact|lokalizacj|adres|address|dojazd|gdzie-jeste"
TRUST = {
    "privacy": r"polityk[ai].{0,12}prywatno|privacy[-_ ]?policy|prywatnosci",
    "contact": r"kontakt|/contact|skontaktuj",
    "about": r"o[-_ ]nas|about[-_ ]?us|/about|o[-_ ]firmie",
    "terms": r"regulamin|terms|warunki|tos([^a-z0-9_]|$)",
}
PAGE_TYPE = (
    ("legal", r"polityk|privacy|regulamin|terms|cookie|rodo|gdpr|warunki", None, 0.9),
    ("contact", r"kontakt|contact|skontaktuj", "contactpage", 0.9),
    ("about", r"o-nas|onas|o-firmie|about|o-mnie|zespol|team|nasza-historia", "aboutpage", 0.85),
    ("product", r"/produkt|/product|/sklep|/shop|/p/", r"product([^a-z0-9_]|$)", 0.85),
    ("blog", None, "article|blogposting|newsarticle", 0.95),
    ("blog", r"/blog|/artykul|/poradnik|/aktualnosci|/news|/wpis|/post|/baza-wiedzy|/wiedza", None, 0.85),
    ("service", None, r"service([^a-z0-9_]|$)", 0.9),
    ("service", r"/uslug|/oferta|/service|/co-robimy|/realizacj|/specjalizacj|/zakres", None, 0.8),
    ("location", r"/lokalizacj|/oddzial|/miasto|/region|/gdzie|/dojazd", "localbusiness", 0.7),
    ("category", r"/kategoria|/category|/tag/|/produkty|/oferty|/uslugi$", None, 0.65),
)
TRANSACTIONAL = "kup|kupic|kupno|kupie|cena|cennik|cenowy|sprzedaz|sprzedam|sprzedazy|wynajem|wynajac|wynajme|najem|tanio|tani|tania|promocja|rabat|sklep|oferta|oferty|zamow|zamowic|koszt|kosztuje|buy|price|sale|rent|cheap|order|deal"
INFORMATIONAL = "jak|co|czy|dlaczego|ile|kiedy|gdzie|czym|jaki|jaka|jakie|jakich|poradnik|porady|krok|przewodnik|instrukcja|definicja|znaczenie|vs|kontra|przyklady|how|what|why|when|guide|tutorial"
CITIES = "warszawa|krakow|lodz|wroclaw|poznan|gdansk|szczecin|bydgoszcz|lublin|katowice|bialystok|gdynia|czestochowa|radom|sosnowiec|torun|kielce|rzeszow|gliwice|zabrze|olsztyn|bielsko|bytom|zakopane|sopot|gniezno"
LOCAL_CUES = "blisko|okolica|okolicy|dzielnica|dzielnicy|osiedle|osiedlu|ulica|ulicy|centrum|wojewodztwo|powiat|gmina|near|local"

# --- keyword and topic constants -----------------------------------------------------------------------------------
FIELD_WEIGHT = {"url": 4, "title": 5, "h1": 4, "headings": 2, "description": 3, "body": 1}
PHRASE_BONUS = {"title": 50, "h1": 35, "url": 30, "headings": 20, "description": 16, "body": 14}
ASSIGN_AT = 25
TOPIC_COSINE = 0.20
GAP_JACCARD = 0.22
NEAR_DUPLICATE, SHINGLE = 0.8, 5
CANNIBAL = 0.6
DAMPING, PAGERANK_ROUNDS = 0.85, 25

# --- structured data: required and recommended properties of types -------------------------------------------------
_LOCAL = ("name address", "telephone openingHoursSpecification geo image priceRange url")
_ARTICLE = ("headline author datePublished", "image dateModified publisher")
SCHEMA_RULES = {
    "Organization": ("name url", "logo sameAs contactPoint"), "Corporation": ("name url", "logo sameAs"), "NGO": ("name url", "logo sameAs"),
    "Person": ("name", "jobTitle image sameAs url"), "WebSite": ("name url", "potentialAction"), "WebPage": ("name", "description"), "BreadcrumbList": ("itemListElement", ""),
    "LocalBusiness": _LOCAL, "Service": ("name", "provider areaServed description"),
    "PostalAddress": ("streetAddress addressLocality", "postalCode addressCountry addressRegion"), "ContactPoint": ("telephone", "contactType areaServed availableLanguage"),
    "OpeningHoursSpecification": ("dayOfWeek opens closes", ""), "GeoCoordinates": ("latitude longitude", ""),
    "Article": _ARTICLE, "BlogPosting": _ARTICLE, "NewsArticle": _ARTICLE, "TechArticle": _ARTICLE,
    "Recipe": ("name image recipeIngredient recipeInstructions", "author datePublished nutrition aggregateRating prepTime cookTime"), "HowTo": ("name step", "image totalTime tool supply"),
    "FAQPage": ("mainEntity", ""), "QAPage": ("mainEntity", ""), "Question": ("name acceptedAnswer", "answerCount"), "Course": ("name description", "provider hasCourseInstance"),
    "Book": ("name author", "isbn publisher"), "PodcastEpisode": ("name url", "datePublished associatedMedia"),
    "VideoObject": ("name thumbnailUrl uploadDate", "description duration contentUrl embedUrl"), "ImageObject": ("contentUrl", "license creator creditText"),
    "Product": ("name", "image offers description brand sku aggregateRating review"), "Offer": ("price priceCurrency", "availability url priceValidUntil itemCondition"),
    "AggregateOffer": ("lowPrice priceCurrency", "highPrice offerCount"), "Review": ("author reviewRating", "itemReviewed datePublished"),
    "AggregateRating": ("ratingValue", "reviewCount ratingCount bestRating"), "Brand": ("name", "logo"),
    "Event": ("name startDate", "location endDate offers image eventStatus description"), "JobPosting": ("title description datePosted hiringOrganization jobLocation", "baseSalary employmentType validThrough"),
    "SoftwareApplication": ("name", "offers aggregateRating operatingSystem applicationCategory"), "MedicalOrganization": _LOCAL,
}
LOCAL_SUBTYPES = (
    "RealEstateAgent Restaurant Store GroceryStore ClothingStore ElectronicsStore Dentist Physician MedicalClinic Hospital Pharmacy VeterinaryCare "
    "Hotel LodgingBusiness BedAndBreakfast Resort Motel ProfessionalService LegalService Attorney Notary AccountingService InsuranceAgency "
    "Plumber Electrician HVACBusiness RoofingContractor GeneralContractor HomeAndConstructionBusiness MovingCompany AutoRepair AutoDealer AutoBodyShop GasStation CarWash "
    "BeautySalon HairSalon NailSalon DaySpa HealthAndBeautyBusiness BankOrCreditUnion FinancialService TravelAgency FoodEstablishment CafeOrCoffeeShop Bakery BarOrPub "
    "EntertainmentBusiness SportsActivityLocation GymOrFitnessCenter ChildCare School EducationalOrganization GovernmentOffice TouristAttraction NightClub Library EmploymentAgency DryCleaningOrLaundry"
).split()
