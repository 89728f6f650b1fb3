"""Plans: the SQL surface (Q1), composed analyses and the catalogue of registered queries."""
