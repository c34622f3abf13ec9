"""Fixed values that results depend on.  Registries that differ by deployment
(aggregators, allow lists, city zones) are parameters read by ``sources.registries``."""

#: Category names in display order.
CATEGORIES = (
    "Arts / Culture",
    "Books / Literature / Poetry",
    "Comedy / Improv",
    "Community / Social",
    "Craft / Maker",
    "Dance / Performance",
    "Education / Workshops",
    "Family / Kids",
    "Film / Cinema",
    "Food / Drink",
    "Gardening / Horticulture",
    "Games / Trivia",
    "Government / Civic",
    "Health / Wellness",
    "LGBTQ+ / Gender",
    "History / Heritage",
    "Music / Concerts",
    "Nature / Outdoors / Recreation",
    "Religion / Spirituality",
    "Schools / K-12",
    "Sports / Fitness",
    "Technology / Careers",
)

#: Category to schema.org type; anything else is an Event.
SCHEMA_TYPES = {
    "Music / Concerts": "MusicEvent",
    "Dance / Performance": "DanceEvent",
    "Comedy / Improv": "ComedyEvent",
    "Education / Workshops": "EducationEvent",
    "Food / Drink": "FoodEvent",
    "Sports / Fitness": "SportsEvent",
    "Film / Cinema": "ScreeningEvent",
    "Books / Literature / Poetry": "LiteraryEvent",
}

#: Substrings that mark a location as virtual.
VIRTUAL = ("zoom", "online", "virtual", "webinar", "http://", "https://", "america/los_angeles", "america/new_york")

#: State and province codes of an address.
REGIONS = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS",
    "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY",
    "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV",
    "WI", "WY", "DC", "AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT",
)

#: Street words of an address.
STREETS = (
    "street", "st", "avenue", "ave", "road", "rd", "drive", "dr", "boulevard", "blvd", "lane", "ln", "way", "court", "ct",
)

#: PRODID pattern to platform, first match wins.
PLATFORMS = (
    (r"ECPv\d", "The Events Calendar (WordPress)"),
    (r"wp-events-plugin\.com", "Modern Events Calendar (WordPress)"),
    (r"Meetup//Meetup Calendar", "Meetup"),
    (r"tockify\.com", "Tockify"),
    (r"Google Inc//Google Calendar", "Google Calendar"),
    (r"iCalendar-Ruby", "Localist"),
    (r"Springshare//LibCal", "LibCal (Springshare)"),
    (r"rianjs/ical\.net", "CivicPlus (ical.net)"),
    (r"BedeWork", "Bedework"),
    (r"MembershipWorks", "MembershipWorks"),
    (r"growthzone\.com", "GrowthZone"),
    (r"Indiana University", "Localist"),
    (r"Golang ICS Library", "Golang ICS"),
    (r"maxpreps\.com", "MaxPreps"),
    (r"bibliocommons\.com", "BiblioCommons"),
)

#: PRODID patterns of generated calendars, which reports skip.
OWN_PRODIDS = (
    r"//combined//",
    r"//\w[\w\s&;'.\-]+//[\w.\-]+\.\w{2,}//",
    r"//\w[\w\s&;'.\-]+//Events//EN",
    r"//\w[\w\s&;'.\-]+//events//EN",
    r"Your Organization//NONSGML",
)

#: Log message class by substring, first match wins.
LOG_CLASSES = (
    ("arg_error", ("the following arguments are required", "unrecognized arguments")),
    ("http_error", ("http error", "client error")),
    ("dns_error", ("failed to resolve", "name or service not known")),
    ("connection_error", ("connectionerror", "connection refused", "connection reset")),
    ("timeout", ("timed out", "timeout")),
    ("parse_warning", ("broken property", "error parsing vevent")),
    ("traceback", ("traceback",)),
)

#: Failed command class by substring of its output, first match wins.
COMMAND_CLASSES = (
    ("arg_error", ("the following arguments are required", "unrecognized arguments")),
    ("http_error", ("http error", "403 client error", "404 client error")),
    ("timeout", ("timed out", "timeout")),
    ("connection_error", ("connection refused", "connection reset", "remote end closed connection")),
    ("traceback", ("traceback",)),
)

#: Path parts that a feed slug leaves out.
SLUG_SKIPS = ("events", "ical", "feed", "calendar", "list", "public", "basic.ics")

#: Snippets, fixed values: how descriptions become plain text, as patterns and replacements in order.
#: The first list is for texts with a tag, before tags and entities are resolved.
SNIPPET_BREAKS = ((r"(?i)<\s*br\s*/?\s*>", "\n"), (r"(?i)<\s*/p\s*>", "\n"), (r"(?i)<\s*li\s*>", "\n"), (r"(?i)<\s*/li\s*>", "\n"))
SNIPPET_CLEANUPS = (
    (r"https?://\S+", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"\\([*_\[\](){}+#>|`~])", "$1"),
    (r"([a-z])([A-Z])", "$1 $2"),
    (r"[\t\r]+", " "),
    (r" {2,}", " "),
)

#: Snippets, fixed values: a label before a sentence, and the words that what follows it needs.
SNIPPET_LABEL = r"^\w+(\s+\w+){0,2}\s*:\s*"
SNIPPET_AFTER_LABEL = r"(?i)\b(the|a|an|and|or|for|with|to|from|at|in|on|by|is|are|was|will|this|that)\b"

#: Snippets, fixed values: sentences that are never shown.
SNIPPET_REJECTS = (
    r"(?i)^(back to|buy|register|sign up|rsvp|tickets?|click|tap|view|see all|read more|get|call or text|call or email)\b",
    r"(?i)\b(zoom|meeting id|passcode|one tap|meeting url|webex|microsoft teams|google meet|agenda|packet|minutes|prohibited|not permitted|are not allowed)\b",
)
SNIPPET_WORLDWIDE = r"(?i)\b(from almost anywhere in the world|from anywhere in the world)\b"

#: Snippets, fixed values: points, for sentences that match the first pattern and not the
#: second, of a least and a most length.
SNIPPET_POINTS = (
    (3, r"[.!?]", None, 0, None),
    (2, r"(?i)\b(the|a|an|and|or|but|for|with|to|from|at|in|on|by)\b", None, 0, None),
    (2, r"(?i)\b(join|learn|discover|explore|enjoy|experience|celebrate|meet|hear|watch|featuring|presents)\b", None, 0, None),
    (-3, r"(?i)(\$\s*\d|\bprice\b|\bfee\b|\badmission\b|\bfree but\b)", None, 0, None),
    (-3, r"\d(\D*\d){5}", None, 0, None),
    (-3, None, r"[.!?]", 0, 24),
    (-3, None, r"(?i)\b(the|a|an|is|are|was|will|has|have|can|do|and|but|for|with|from)\b", 0, 39),
    (1, None, None, 40, None),
    (-2, None, None, 221, None),
)
#: Snippets, fixed values: points for the title alone, and for the title and little else.
SNIPPET_TITLE_POINTS = (-6, -4)

#: Connectors that are configuration only, fixed values: source, kind, domain, zone, default
#: location, and the site or page that its links are relative to.
CONNECTORS = (
    ("Bloomington Symphony Orchestra", "tribe", "bloomingtonsymphony.com", "America/Indiana/Indianapolis", "Buskirk-Chumley Theater, 114 E Kirkwood Ave, Bloomington, IN 47408", "https://www.bloomingtonsymphony.com/"),
    ("Brewsters Beer Garden", "squarespace", "brewstersbeergarden.com", "America/Los_Angeles", "Brewsters Beer Garden, 229 Water St, Petaluma, CA 94952", "https://brewstersbeergarden.com"),
    ("City Planning Consultations", "social_pinpoint", "haveyoursay.toronto.ca", "America/Toronto", "", "https://haveyoursay.toronto.ca/city-planning-development-review-community-consultations"),
    ("City of Toronto Public Consultations", "social_pinpoint", "haveyoursay.toronto.ca", "America/Toronto", "", "https://haveyoursay.toronto.ca/events"),
    ("Jazz House Kids", "tribe", "jazzhousekids.org", "America/New_York", "Montclair, NJ", "https://jazzhousekids.org/"),
    ("Limestone Post", "cityspark", "limestonepost.org", "America/Indiana/Indianapolis", "", "https://limestonepost.org/calendar/"),
    ("Mercury Theater", "squarespace", "mercurytheater.org", "America/Los_Angeles", "Mercury Theater, 3333 Petaluma Blvd N, Petaluma, CA 94952", "https://www.mercurytheater.org"),
    ("NAMI Greater Bloomington", "tribe", "namigreaterbloomingtonarea.org", "America/Indiana/Indianapolis", "Bloomington, IN", "https://namigreaterbloomingtonarea.org/"),
    ("NJ Poetry Events", "squarespace", "njpoetryevents.com", "America/New_York", "NJ", "https://www.njpoetryevents.com"),
    ("Pushcart Players", "tribe", "pushcartplayers.org", "America/New_York", "Verona, NJ", "https://pushcartplayers.org/"),
    ("Skyline Theatre Company", "tribe", "skylinetheatrecompany.org", "America/New_York", "Bloomfield, NJ", "https://skylinetheatrecompany.org/"),
    ("The Bluebird", "seetickets", "thebluebird.ws", "America/Indiana/Indianapolis", "Bluebird Nightclub, 216 N Walnut St, Bloomington, IN", "https://www.thebluebird.ws/"),
    ("Third Room", "seetickets", "thirdroom.art", "America/New_York", "Third Room, 46 Wall St, Asheville, NC 28801", "https://thirdroom.art/calendar/"),
    ("Toronto Catholic District School Board Meetings", "escribe", "tcdsbpublishing.escribemeetings.com", "America/Toronto", "", "https://tcdsbpublishing.escribemeetings.com/"),
    ("Toronto District School Board Meetings", "escribe", "pub-tdsb.escribemeetings.com", "America/Toronto", "", "https://pub-tdsb.escribemeetings.com/"),
    ("Toronto Public Library", "bibliocommons", "tpl.bibliocommons.com", "America/Toronto", "", ""),
    ("Volunteer Toronto", "bibliocommons", "tpl.bibliocommons.com", "America/Toronto", "", ""),
    ("WFHB Community Calendar", "em_events", "wfhb.org", "America/Indiana/Indianapolis", "Bloomington, IN", "https://wfhb.org/"),
    ("Writers Guild at Bloomington", "sugar_calendar", "writersguildbloomington.com", "America/Indiana/Indianapolis", "Bloomington, IN", "https://writersguildbloomington.com/events/"),
)

#: Bare quotes inside a JSON description, fixed values: the value's place, and what to escape in it.
JSON_DESCRIPTION = r'"description":\s*"(.+?)"\s*[,}]'
BARE_QUOTE = r'(?<!\\)"'

#: Feed slugs, fixed values: where a provider shows (host or path) and by what, the lead of its
#: slug, the pattern of the part that must be there (or null), and the pattern of an optional
#: last part.
SLUG_RULES = (
    ("host", "meetup.com", "meetup_", r"meetup\.com/([^/]+)", None),
    ("host", "tockify.com", "tockify_", r"/ics/([^/]+)", None),
    ("path", "/iCalendar/iCalendar.aspx", "civicplus_", None, r"catID=(\d+)"),
    ("path", "/fs/calendar-manager/", "", None, r"calendar_ids(?:%5B%5D|\[\])?=(\d+)"),
    ("host", "calendar.google.com", "gcal_", r"ical/([^%/]+)", None),
    ("host", "libcal.com", "libcal_", None, r"cid=(\d+)"),
    ("host", "campuslabs.com", "campuslabs_", None, None),
    ("path", "/live/ical/", "", None, r"group_id/(\d+)"),
)

#: A weekday in words, ordinals in words, and the phrases that state a recurrence, in
#: the order in which they are tried: pattern, frequency, group of the ordinal, group of the day.
WEEKDAY = "sunday|monday|tuesday|wednesday|thursday|friday|saturday"
ORDINALS = {"first": "1", "second": "2", "third": "3", "fourth": "4"}
RECURRENCE_WORDS = (
    (
        rf"(?:every|on)\s+({WEEKDAY})s?"
        r"(?![,\s]+(?:january|february|march|april|may|june|july|august|september|october|november|december"
        r"|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)\b)",
        "WEEKLY", 0, 1,
    ),
    (r"\bevery\s+week\b|\bweekly\b", "WEEKLY", 0, 0),
    (rf"(\d+)(?:st|nd|rd|th)\s+(?:and\s+\d+(?:st|nd|rd|th)\s+)?({WEEKDAY})", "MONTHLY", 1, 2),
    (rf"(first|second|third|fourth)\s+({WEEKDAY})", "MONTHLY", 1, 2),
    (r"\bmonthly\b", "MONTHLY", 0, 0),
)

_SEE = {"title": "p.title", "date": "p.date", "time": "span.see-showtime", "location": "p.venue", "url": "a.seetickets-buy-btn@href"}
_SEE_BOX = ".seetickets-list-event-container"

#: Connectors with a page layout of their own, fixed values: source, box, places, site, zone, hour of
#: events without a time, default location.
LAYOUTS = (
    ("Aga Khan Museum", "section.c-masthead", {"title": "div.c-masthead__container h1.c-masthead__title", "date": "p.c-masthead__date-label", "time": "p.c-masthead__time-label"},
     "https://agakhanmuseum.org", "America/Toronto", "00:00", "Aga Khan Museum"),
    ("Carolina Theatre", ".eventCard", {"title": ".card__title", "date": ".month + .day", "time": ".card__info", "url": "a[href]@href"},
     "https://carolinatheatre.org", "America/New_York", "19:00", "Carolina Theatre, 309 W Morgan St, Durham, NC 27701"),
    ("Cinnabar Theater", "div.pp-content-post.type-show", {"title": "h3.pp-content-grid-title", "date": "div.pp-content-grid-content p", "url": "a.pp-post-link@href"},
     "https://cinnabartheater.org", "America/Los_Angeles", "00:00", "Cinnabar Theater, 3333 Petaluma Blvd N, Petaluma, CA 94952"),
    ("FAR Center for Contemporary Arts", ".entry-main div.mb-8", {"title": "h3 a", "date": "p.text-sm.mb-1", "url": "h3 a@href"},
     "https://thefar.org", "America/Indiana/Indianapolis", "00:00", "FAR Center for Contemporary Arts, 505 W 4th St, Bloomington, IN"),
    ("Flash", "article.listing", {"title": '[itemprop="name"]', "date": 'time[itemprop="startDate"]@datetime', "url": 'a[itemprop="url"]@href', "description": "div.server-content"},
     "https://www.flashdc.com", "America/New_York", "22:00", "Flash Nightclub, 645 Florida Ave NW, Washington, DC 20001"),
    ("Green Music Center", "div.event_container", {"title": ".title a", "date": ".e_month + .e_date", "time": ".e_time", "location": ".e_location", "url": ".summary a@href", "description": ".summary a"},
     "https://gmc.sonoma.edu", "America/Los_Angeles", "20:00", "Green Music Center, 1801 E Cotati Ave, Rohnert Park, CA 94928"),
    ("Lagunitas Brewing Company", ".event-row", {"title": ".desc h2", "date": ".date", "time": ".time-wrap .time", "url": ".buy-btn a@href"},
     "https://lagunitas.com/taproom/petaluma/", "America/Los_Angeles", "00:00", "Lagunitas Brewing Company, 1280 N McDowell Blvd, Petaluma, CA 94954"),
    ("The Bluebird", _SEE_BOX, _SEE, "https://www.thebluebird.ws", "America/Indiana/Indianapolis", "20:00", "Bluebird Nightclub, 216 N Walnut St, Bloomington, IN"),
    ("Third Room", _SEE_BOX, _SEE, "https://thirdroom.art", "America/New_York", "20:00", "Third Room, 46 Wall St, Asheville, NC 28801"),
    ("Toronto Community Housing", "a.node.node--type-event.node--view-mode-listing-item", {"title": "h3", "date": "time", "location": "p.address", "url": "&@href", "description": "p"},
     "https://torontohousing.ca", "America/Toronto", "00:00", "Toronto"),
    ("WFHB Community Calendar", ".em-event", {"title": ".em-item-title a", "date": ".em-event-date", "time": ".em-event-time", "location": ".em-event-location", "url": ".em-item-title a@href", "description": ".em-event-description"},
     "https://wfhb.org", "America/Indiana/Indianapolis", "00:00", "Bloomington, IN"),
    ("Writers Guild at Bloomington", ".sugar-calendar-event-list-block__listview__event", {"title": "[class*=__title]", "date": "[class*=__date]", "url": "a[href]@href"},
     "https://writersguildbloomington.com", "America/Indiana/Indianapolis", "00:00", "Bloomington, IN"),
)
