"""Lines of sight over elevation fields."""
