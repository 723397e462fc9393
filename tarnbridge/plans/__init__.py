"""Plans over whole databases: DDL, migration, text conversion."""
