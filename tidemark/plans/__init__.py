"""Query plans: named result tables and the SQL that checks them."""
