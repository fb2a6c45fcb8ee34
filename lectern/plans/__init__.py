"""The registered queries and the SQL they are held against."""
