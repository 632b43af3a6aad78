"""Compositions of operators: mining, and the SQL used to check them."""
