"""Word lists that the plans classify by; fixed values."""

PART_CLASSES = {
    "Metal": ["steel", "copper", "brass", "tin", "nickel", "chrome"],
    "Large": ["large", "jumbo", "big"],
    "Small": ["small", "mini"],
    "Colour": ["red", "green", "blue", "white", "black", "almond", "azure"],
}
REQUIRED_PART_CLASSES = ["Metal", "Large", "Colour"]
