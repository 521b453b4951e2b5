"""docquarry.model"""
