"""Sample words of the table generator."""

FIRST_NAMES = (
    "Alice", "Bob", "Carlos", "Diana", "Edward", "Fatima", "George", "Hannah", "Ivan", "Julia",
    "Kevin", "Laura", "Miguel", "Nina", "Oscar", "Patricia", "Quinn", "Rachel", "Samuel", "Tanya",
    "Uma", "Victor", "Wendy", "Xavier", "Yara", "Zachary",
)
LAST_NAMES = (
    "Johnson", "Smith", "Garcia", "Williams", "Brown", "Jones", "Miller", "Davis", "Wilson", "Taylor",
    "Anderson", "Thomas", "Jackson", "White", "Harris", "Martin", "Thompson", "Young", "Lewis",
)
DOMAINS = ("example.com", "mail.io", "corp.dev", "acme.co", "test.net")
STATUSES = ("active", "pending", "completed", "cancelled", "inactive")
COUNTRIES = (
    "United States", "United Kingdom", "Germany", "France", "Japan", "Brazil", "Canada", "Australia",
    "India", "Mexico", "South Korea", "Netherlands", "Sweden", "Norway", "Denmark", "Switzerland",
    "Singapore", "New Zealand", "South Africa", "Nigeria", "Kenya", "Argentina", "Chile", "Colombia",
    "Turkey", "Poland", "Czech Republic", "Portugal", "Spain", "Italy", "Greece", "Egypt", "Morocco",
)
COUNTRY_CODES = (
    "US", "GB", "DE", "FR", "JP", "BR", "CA", "AU", "IN", "MX", "KR", "NL", "SE", "NO", "DK", "CH",
    "SG", "NZ", "ZA", "NG", "KE", "AR", "CL", "CO", "TR", "PL", "CZ", "PT", "ES", "IT", "GR", "EG", "MA",
)
CITIES = ("Austin", "London", "Toronto", "Berlin", "Paris", "Tokyo", "Madrid", "Lagos", "Mumbai", "Sydney")
STATES = (
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida",
    "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine",
    "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana", "Nebraska",
    "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio",
    "Oklahoma", "Oregon", "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas",
    "Utah", "Vermont", "Virginia", "Washington", "West Virginia", "Wisconsin", "Wyoming",
)
STATE_CODES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA",
    "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK",
    "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
)
STREET_NAMES = ("Oak", "Maple", "Cedar", "Pine", "Elm", "Washington", "Lincoln", "Park", "Lake", "Hill")
STREET_TYPES = ("St", "Ave", "Blvd", "Rd", "Ln", "Dr")
COMPANY_SUFFIXES = ("Inc", "LLC", "Group", "Co", "Labs")
