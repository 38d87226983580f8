"""Query plans over the driver's tables; importing a module registers its queries."""
